"""Token files and packing against the plain tokenizer."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from pyspark import TaskContext
from tokenizers import Tokenizer

from strata.llm import packing as PK
from strata.llm import token_files as TF
from strata.llm.store import ARROW_ROWS, TEXT_ROWS, shared_path
from strata.llm.tokens import Encoder, default_path

ODD = ["", None, " ", "a  b", " a b ", "a\n\n b c", "it's o'clock 'll x", "<|endoftext|> a <|endoftext|>b", "a\x1c b c", "é ü  \t x ", "a\u0085 b", "x " * 40_000, "y" * 3000]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_path())


def odd_docs(spark, plain=None):
    rows = [(i * 7 % 13, t, "k") for i, t in enumerate(ODD)] + [(None, "no id", "k"), (3, "twice", "k"), (3, "twice", "k")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string")


def ids_of(plain, text, end):
    return [*plain.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_memo_equals_whole_texts(plain):
    e = Encoder(default_path())
    for t in [*ODD, *ODD]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(plain, t, 0)[:-1]


def test_memo_with_odd_white_space(plain):
    e = Encoder(default_path())
    texts = [
        "a b", "a b\n", "a b\n c", "q b\n", "a\n b c", "a b c \n", "x b c \n d", "\na b", "a \tb c", "a b\t c", "a b\u00a0 c", "a \nb. c",
        "a \n, b", "a  b", "b. ,", "a . b , c", "\u0120 \u0120a", "<|endoftext|> a", " ", "a" * 99 + " b " + "c" * 99 + " b", "\x1c x y",
    ]
    for t in texts * 2:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(plain, t, 0)[:-1], t


def test_a_chunk_is_remembered_once(plain):
    e = Encoder(default_path())
    e.encode("some words here, again")
    e.old, e.new = e.new, {}
    for t in ("the words here, again", "the words again, here"):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(plain, t, 0)[:-1]
    assert e.new and not e.new.keys() & e.old.keys()


def test_packing_takes_few_texts_at_a_time(spark, monkeypatch):
    def cut(tokenizer, capacity, end_id):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                columns = [batch.column(0), *[pa.array([v] * n, t) for v, t in ((0, pa.int32()), (n, pa.int64()), (capacity, pa.int64()), (0, pa.int64()), (TaskContext.get().partitionId(), pa.int32()))]]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(0)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

        return run

    monkeypatch.setattr(PK, "_cut", cut)
    before = spark.conf.get(ARROW_ROWS)
    got = PK.pack(spark.range(2 * TEXT_ROWS + 1, numPartitions=1).selectExpr("id AS doc_id", "'a' AS text")).collect()
    assert sorted(r.doc_id for r in got) == list(range(2 * TEXT_ROWS + 1))
    assert {r.start for r in got} == {TEXT_ROWS, 1}
    assert spark.conf.get(ARROW_ROWS) == before


def test_elias_fano():
    rng = np.random.default_rng(0)
    for v in ([], [0], [5, 5, 5, 9], np.cumsum(rng.integers(0, 5000, 3000)).tolist(), [0] * 1000, [2**60]):
        e = TF.EliasFano.from_bytes(TF.EliasFano.build(np.array(v, dtype=np.uint64)).to_bytes())
        assert e.all().tolist() == v
        assert [e.select(i) for i in range(len(v))] == v
    big = np.cumsum(rng.integers(0, 2000, 20_000))
    assert len(TF.EliasFano.build(big).to_bytes()) * 8 < 20_000 * 14


def test_files_round_trip(spark, plain):
    rows, df = odd_docs(spark)
    folder = shared_path(spark, "tok")
    manifest = TF.write_token_files(df, folder)
    got = sorted(TF.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted((str(i), len(x), crc(x)) for i, t, _ in rows for x in [ids_of(plain, t, 0)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    f = TF.TokenFile(f"{folder}/shard-000000.tok")
    by_id = {(i, crc(ids_of(plain, t, 0))) for i, t, _ in rows}
    for k in range(len(f)):
        assert (f.doc_id(k), crc(f.read(*f.bounds(k)).astype("<u4"))) in by_id
    f.close()
    assert TF.round_trip(df.limit(0)).collect() == []


def check_packing(rows, pieces, plain, capacity, end):
    assert {r.length for r in pieces} <= set(range(1, capacity + 1))
    by_sequence, want = {}, []
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in rows:
        x = ids_of(plain, t, end)
        cuts = [0, *range(len(x) % capacity or capacity, len(x) + 1, capacity)]
        want += [(str(i), p, cuts[p], cuts[p + 1] - cuts[p], crc(x[cuts[p] : cuts[p + 1]])) for p in range(len(cuts) - 1)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(want)
    return len(by_sequence), -(-sum(r.length for r in pieces) // capacity)


def test_pack_documents(spark, plain):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    used, least = check_packing([(r.doc_id, r.text) for r in docs.collect()], PK.pack(docs).collect(), plain, 1024, 2)
    assert used <= 1.06 * least


def test_pack_odd_rows(spark, plain):
    rows, df = odd_docs(spark)
    check_packing([r[:2] for r in rows], PK.pack(df, capacity=64).collect(), plain, 64, 2)
    assert PK.pack(df.limit(0)).collect() == []


def test_plan_holds_histogram_exactly():
    rng = np.random.default_rng(1)
    for sizes, slack in ((rng.integers(1, 1025, 4000), 1.01), (rng.choice([300, 400, 500, 341, 700], 3000), 1.08), (np.full(999, 1024), 1.0), (np.full(77, 513), 2.0)):
        h = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        plan, got = PK.solve(h, rounds=60), {}
        for config, times in plan:
            assert times > 0 and sum(k * n for k, n in config) <= 1024
            for k, n in config:
                got[k] = got.get(k, 0) + n * times
        assert got == h
        assert sum(t for _, t in plan) <= slack * -(-int(sizes.sum()) // 1024) + 1
    assert PK.solve({}) == []


def test_program_covers_every_length_and_places_most():
    rng = np.random.default_rng(5)
    h = dict(zip(*(x.tolist() for x in np.unique(rng.triangular(1, 300, 1023, 9000).astype(int), return_counts=True)), strict=True))
    lengths, need = np.array(sorted(h)), np.array([h[k] for k in sorted(h)])
    covered = dict.fromkeys(h, 0.0)
    for config, times in PK._weights(lengths, need, 1024, None, 1 / 8).items():
        for k, n in config:
            covered[k] += times * n
    assert all(abs(covered[k] - h[k]) < 1e-6 for k in h)
    program, rest = PK.solve_parts(h)
    placed = sum(times * sum(n for _, n in config) for config, times in program)
    assert placed >= 0.8 * need.sum()
    assert sum(t for _, t in program + rest) <= 1.002 * -(-int(lengths @ need) // 1024) + 1


def test_price_uses_the_room_within_the_counts():
    # Unbounded, ten pieces of 10 would win and be cut to two.
    assert PK.price(np.array([10, 40]), np.array([11.0, 40.0]), np.array([2, 2]), 100) == ((40, 2), (10, 2))


def test_blocks_equal_single_selects():
    rng = np.random.default_rng(12)
    for values in (np.sort(rng.integers(0, 10**6, 3000)), np.arange(900), np.zeros(700, dtype=int), np.cumsum(rng.integers(0, 3, 5000)), np.array([5]), np.sort(rng.integers(0, 2**40, 400))):
        ef = TF.EliasFano.from_bytes(TF.EliasFano.build(values).to_bytes())
        for first, count in ((0, len(values)), (0, 1), (len(values) - 1, 5), (255, 3), (256, 256), (511, 700), (len(values), 4)):
            if first <= len(values):
                want = values[first : first + count].tolist()
                assert ef.block(first, count).tolist() == want
                assert [ef.select(i) for i in range(first, first + len(want))][:20] == want[:20]


def test_one_id_fills_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TF, "SHARD_BYTES", 2000)
    rows = [(7, f"text number {i} of one id") for i in range(400)] + [(None, "no id")] * 300 + [(1, "x"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = TF.write_token_files(df, f"file://{tmp_path}/t")
    assert manifest.filter("documents > 0").count() > 4
    got = TF.read_token_files(manifest, f"file://{tmp_path}/t").orderBy("start").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
