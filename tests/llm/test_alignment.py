"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from conftest import SF_SMALL

from strata.llm import alignment as AL


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = AL.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def plain(rows):
    """Whole texts, one at a time, groups by common ends."""
    a, b = tokenizers()
    alphabet = AL.byte_alphabet()
    names = {i: p for p, i in a.get_vocab().items()}
    docs = []
    for i, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        wa = [bytes(alphabet[c] for c in names[t]) for t in x]
        wb = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
        own = b" " + (text or "").encode()
        if not text or b"".join(wa) != own or b"".join(wb) != own:
            docs.append((i, 0, 0, [], []))
            continue
        ends = [np.cumsum([len(w) for w in side]).tolist() for side in (wa, wb)]
        groups, ga, gb, at = [], [], [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            ga, gb = [], []
            while at[0] < len(x) and ends[0][at[0]] <= end:
                ga.append(x[at[0]])
                at[0] += 1
            while at[1] < len(y) and ends[1][at[1]] <= end:
                gb.append(y[at[1]])
                at[1] += 1
            groups.append((ga, gb))
        links = [(s, t) for p, q in groups for s in p for t in q]
        docs.append((i, len(x), len(y), groups, links))
    count = Counter(pair for d in docs for pair in set(d[4]))
    best = defaultdict(int)
    for (s, _), n in count.items():
        best[s] = max(best[s], n)
    out = []
    for i, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if links else ""
        out.append((i, na, nb, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_coalesce_breaks_where_both_end():
    starts, ends = np.array([0, 3, 5, 0, 5, 8]), np.array([3, 5, 9, 5, 8, 9])
    assert AL.coalesce(starts, ends).tolist() == [0, 0, 1, 0, 1, 1]
    assert AL.coalesce(np.array([], dtype=int), np.array([], dtype=int)).tolist() == []


def test_odd_texts_equal_plain(spark):
    texts = [
        None, "", " ", "  a", "a  b\n\nc ", " lead", "trail ", "x\ty　z", "ﬁ é <s> </s> <|endoftext|> <unk>",
        "a ▁b", "▁", "don't 'll they're 12 345", "a\n b", "a \nb c", "\U0001f600 \U0001f600‍ déjà vu", "q" * 5000 + " z",
        "word " * 3000, "a\x1cb \x1c c", "\x00 \x00a", "the the the", "the the the", "你好 世界",
    ]
    rows = [(i if i != 20 else 19, t) for i, t in enumerate(texts)] + [(None, "the cat")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, row int")
    got = [tuple(r) for r in AL.align_documents(df.repartition(3)).collect()]
    assert order(got) == order(plain(rows))
    assert AL.align_documents(df.limit(0)).collect() == []


def test_documents_equal_plain(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = order(plain(rows))
    assert order([tuple(r) for r in AL.align_documents(docs).collect()]) == want
    # Starting the memo anew and joining without a broadcast change nothing.
    monkeypatch.setattr(AL, "BROADCAST_PAIRS", 0)
    assert order([tuple(r) for r in AL.align_documents(docs.repartition(5)).collect()]) == want


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(AL, "MEMO_CHUNKS", 3)
    aligner = AL.Aligner(*AL.default_paths())
    texts = [f"one two{i} three{i}" for i in range(9)]
    many = AL.Aligner(*AL.default_paths()).align(texts)
    ones = [aligner.align([t]) for t in texts]
    assert [d for x in ones for d in x[1]] == many[1]
    assert np.concatenate([x[0]["n_links"] for x in ones]).tolist() == many[0]["n_links"].tolist()
