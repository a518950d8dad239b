import pyarrow as pa

from quillspark.llm.text import MARKS, grams, pieces, shingle_sets, words

TEXTS = ["The  cat\tsat", None, "", "   ", "the CAT sat", "élan ÉLAN", "a", "x" * 5000 + " y", "b\x0bc\x1cd"]


def test_words_are_runs_of_non_separators():
    found = words(pa.array(TEXTS))
    expect = [len((t or "").encode().split()) if t != TEXTS[-1] else 2 for t in TEXTS]
    assert found.counts.tolist() == expect


def test_equal_words_hash_alike_whatever_their_place():
    found = words(pa.array(TEXTS))
    first, again = found.hashes[:3], found.hashes[3:6]
    assert (first == again).all()
    assert len(set(found.hashes.tolist())) == len({w for t in TEXTS for w in (t or "").encode().lower().split()} - {b"b\x0bc\x1cd"} | {b"b", b"c\x1cd"})


def test_slices_and_pieces_agree():
    array = pa.array(TEXTS * 3)
    whole = words(array)
    parts = [words(p).hashes.tolist() for _, p in pieces(array, 40)]
    assert [h for p in parts for h in p] == whole.hashes.tolist()
    assert words(array.slice(4, 3)).counts.tolist() == whole.counts[4:7].tolist()


def test_marks_separate_too():
    assert words(pa.array(["don't stop-now"]), MARKS).counts.tolist() == [4]


def test_shingles_of_short_texts():
    sets = shingle_sets(words(pa.array(["a b c d e", "a b", "b a", None, "a b c d e a b c d e"])), 4)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 5]
    assert sets[1][0] != sets[2][0]


def test_grams_stay_within_a_text():
    hashes, owner = grams(words(pa.array(["a b c", "d e"])), 2)
    assert owner.tolist() == [0, 0, 1]
    assert len(grams(words(pa.array(["a b c"])), 2, step=2)[0]) == 1
