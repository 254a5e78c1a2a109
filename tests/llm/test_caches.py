"""A worker remembers for one kind of work at a time."""

from strata.llm import alignment, caches, decontaminate, tokens


def test_other_kinds_are_forgotten():
    e = tokens.encoder(tokens.default_path())
    want = e.encode("some words here again some words")
    assert e.new
    decontaminate.bare("é»".encode())
    caches.enter("decontaminate")
    assert not e.new and not e.old
    decontaminate.bare("é»".encode())
    assert decontaminate._bare.cache_info().currsize
    assert tokens.encoder(tokens.default_path()) is e and e.encode("some words here again some words") == want
    assert not decontaminate._bare.cache_info().currsize
    tokens.encoder(tokens.default_path())
    assert e.new
    a = alignment._aligners.setdefault(("x", "y"), alignment.Aligner(*alignment.default_paths()))
    a.align(["two words"])
    caches.enter("alignment")
    assert a.known and not e.new
    caches.enter("toxicity")
    assert not a.known
    alignment._aligners.pop(("x", "y"))
