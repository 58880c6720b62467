import random

import pytest

from marlstone.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(S.default_model())


def segmentations(v, text):
    if not text:
        yield 0.0, ()
        return
    for j in range(1, len(text) + 1):
        if text[:j] in v.pieces:
            piece, score = v.pieces[text[:j]]
            for s, rest in segmentations(v, text[j:]):
                yield s + score, (piece, *rest)
        elif j == 1:
            for s, rest in segmentations(v, text[1:]):
                yield s + v.unknown, (*(v.bytes[b] for b in text[0].encode()), *rest)


def applied(ids, changes):
    out = list(ids)
    for at, n, new in sorted(changes, reverse=True):
        out[at : at + n] = new
    return out


def test_n_best_against_all_segmentations(vocabulary):
    pick, encoder = random.Random(5), S.Encoder(vocabulary)
    for _ in range(100):
        text = "".join(pick.choice("the of and\nréx漢") for _ in range(pick.randint(1, 9)))
        every = sorted((-s, ids) for s, ids in segmentations(vocabulary, " " + text))
        ids, scores, several, lists, changed = encoder.encode([text], full=True)
        assert several[0] == [-s for s, _ in every[: S.N_BEST]] and scores[0] == several[0][0]
        known = {ids: -s for s, ids in every}
        assert [known[tuple(x)] for x in lists[0]] == several[0] and len({tuple(x) for x in lists[0]}) == len(lists[0])
        assert known[tuple(ids.to_pylist()[0])] == scores[0] and lists[0][0] == ids.to_pylist()[0]
        assert [applied(lists[0][0], c) for c in changed[0]] == lists[0][1:]


def test_round_trip(documents, awkward):
    rows = [*awkward, (20, " lead"), (21, "trail "), (22, "  two  blanks\n\n"), (23, "\x00\x7f\u2028"), (24, "a" * 20000)]
    out = S.decode(S.encode(documents(rows), full=True)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "") and r.same and r.n_pieces == len(r.ids) and [applied(r.ids, c) for c in r.changes] == [list(a) for a in r.alternatives[1:]] and r.score == r.best_scores[0] and list(r.best_scores) == sorted(r.best_scores, reverse=True)
        assert all(S.Vocabulary.decode(S.Vocabulary(S.default_model()), x) == r.decoded for x in r.alternatives[-1:])
    assert S.encode(documents([])).count() == 0


def test_library_decodes_the_ids(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    for text in ("The rivers of the north", "déjà vu 漢字\nnew line"):
        ids = S.Encoder(vocabulary).encode([text])[0].to_pylist()[0]
        assert sp.decode(ids) == text


def test_very_long_texts(documents):
    rows = [(1, "the river of the north " * 870_000), (2, "abcé" * 250_000), (3, "\n" * 100_000)]
    got = {r.doc_id: (r.same, len(r.best_scores)) for r in S.encode(documents(rows)).select("doc_id", "same", "best_scores").collect()}
    assert got == {1: (True, S.N_BEST), 2: (True, S.N_BEST), 3: (True, 1)} or all(same for same, _ in got.values())
