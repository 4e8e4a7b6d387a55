"""Problems 6, 7 and 8: token ids, leaked passages, one form of text."""

import random
import subprocess
import sys
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from helixmill.llm import byte_bpe, leaks, plain_text

tiktoken = pytest.importorskip("tiktoken")

TEXTS = [None, "", " ", "\n\n", "the cat sat", "don't stop", "naïve café", "みしきまスビラン。", "книга и мир", "a" * 5000, "<|endoftext|> x", "  two  spaces ", "x​y", "1234567 ½ ²", "word " * 2000, "🙂🙂"]

BACK: dict[int, bytes] = {}


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(open(byte_bpe.VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def encoder(ranks):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_a_reference_encoder(spark, encoder):
    df = spark.createDataFrame([(i, t, "clash", t) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, plain string")
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.token_ids(df).collect()}
    assert got == {i: encoder.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_ids_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert byte_bpe.token_ids(df).count() == 3
    assert byte_bpe.token_ids(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_merges_of_long_words_are_those_of_short_ones(ranks, text):
    raw = text.encode("utf-8", "ignore")
    if raw:
        back = {r: t for t, r in ranks.items()} if not BACK else BACK
        BACK.update(back)
        ids = byte_bpe.merge_long(raw, ranks)
        assert ids == byte_bpe.merge_short(raw, ranks)
        assert b"".join(BACK[i] for i in ids) == raw


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("ｆｕｌｌ １２", "full 12"),
        ("ﬁne", "fine"),
        ("café", "café"),
        ("ス​ヒﾞ", "スビ"),
        ("ｽﾋﾞ", "スビ"),
        ("a\xa0b　c d", "a b c d"),
        ("so\xadft﻿", "soft"),
        ("pаssаge", "passage"),
        ("οnly", "only"),
        ("мир", "мир"),
        ("оса and cat", "оса and cat"),
        ("Case É", "Case É"),
        ("line\nend", "line\nend"),
        ("résumé рlan", "résumé plan"),
        ("aԱс", "aԱc"),
        ("ZאА", "ZאA"),
        ("с1ֆx_оса", "c1ֆx_оса"),
        ("", ""),
    ],
)
def test_plain_text(text, plain):
    assert plain_text.plain_text(text) == plain
    assert plain_text.plain_text(plain) == plain


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="acсοА1Աא_ ́б", max_size=20))
def test_every_word_with_latin_letters_takes_the_latin_spelling(text):
    text = plain_text._ordinary(text)
    want = plain_text._WORD.sub(lambda m: m.group().translate(plain_text._TO_LATIN) if plain_text._HAS_LATIN.search(m.group()) else m.group(), text)
    assert plain_text.plain_text(text) == plain_text._ordinary(want)


def test_long_words_take_one_pass():
    began = time.time()
    assert plain_text.plain_text("x" * 300_000 + " б") == "x" * 300_000 + " б"
    assert plain_text.plain_text("б" * 300_000 + " x") == "б" * 300_000 + " x"
    assert time.time() - began < 5


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aеοо xｆ​́\xa0é1-ﬁヒﾞ\n", max_size=30))
def test_plain_text_is_idempotent(text):
    once = plain_text.plain_text(text)
    assert plain_text.plain_text(once) == once


def test_functions_carry_their_code(tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(plain_text.plain_text))
    out = subprocess.run([sys.executable, "-c", "import pickle; print(pickle.load(open('f', 'rb'))('p\u0430ge'))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "page"


def test_script_sets_and_confusable_words():
    assert plain_text.script_set("abc1") == {"Latin"}
    assert plain_text.script_set("12") == {"Latin", "Cyrillic", "Greek"}
    assert not plain_text.script_set("aб") and not plain_text.script_set("aԱ")
    assert plain_text.script_set("漢字かな") == {"Japanese"} and plain_text.script_set("ԱԲ") == {"Armenian"}
    assert plain_text.confusable_words("pаge оса мир page") == (1, 1)


def test_same_looking_pairs(spark):
    rows = [(1, "pаge"), (2, "page"), (3, "page"), (4, None), (5, ""), (6, " "), (7, "\xa0"), (8, "ｐage"), (9, "Page"), (None, "pａge"), (10, "x" * 100_000), (11, "x" * 99_999 + "ｘ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, form string")
    got = sorted(map(tuple, plain_text.same_looking(df).collect()))
    assert got == [(1, 2), (1, 3), (1, 8), (2, 8), (3, 8), (10, 11)]
    assert plain_text.same_looking(df.where("false")).count() == 0


def _leaks(spark, docs, items):
    (held,) = leaks.blocks(spark.createDataFrame(items, "item_id long, text string"))
    numbers = leaks.numbered(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, words string"), held)
    vectors = leaks.latent_words(numbers, leaks.document_weights(numbers, held.size))
    return numbers, held, vectors


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 30)))) for i in range(20)] + [(97, None), (98, ""), (99, "too few words")]
    docs = []
    for i in range(150):
        words = [rng.choice([*vocab, "other"]) for _ in range(rng.randint(0, 60))]
        if i % 2:
            source = rng.choice(items[:20])[1].split()
            k = rng.randint(8, 14)
            at = rng.randint(0, max(0, len(source) - k))
            words[len(words) // 2 : len(words) // 2] = [w.upper() if rng.random() < 0.2 else w for w in source[at : at + k]]
        docs.append((i, "'''" + " | ".join(words) + "]]"))
    docs += [(900, None), (901, ""), (902, docs[1][1]), (None, docs[1][1])]
    windows = {}
    for i, t in items:
        w = (t or "").split()
        for k in range(len(w) - 9):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(d, i) for d, t in docs if d is not None for w in [leaks.words_of(t)] for k in range(len(w) - 9) for i in windows.get(tuple(w[k : k + 10]), ())}
    numbers, held, vectors = _leaks(spark, docs, items)
    got = list(map(tuple, leaks.leaked(numbers, held, vectors).collect()))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_rare_items_are_found_however_large_the_corpus(spark, monkeypatch):
    import numpy as np

    rng = random.Random(13)
    common = [f"c{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(common) for _ in range(25))) for i in range(5)] + [(50 + i, " ".join(f"r{i}x{j}" for j in range(10))) for i in range(3)]
    docs = [(i, t) for i, t in items]
    product = leaks._product

    def enlarged(numbers, matrix, weight):
        out = product(numbers, matrix, weight)
        out[1 : 1 + len(common)] *= 1e9  # as if the frequent passages stood there a billion times
        return out

    monkeypatch.setattr(leaks, "_product", enlarged)
    numbers, held, vectors = _leaks(spark, docs, items)
    assert (np.abs(vectors[1:]).max(axis=1) > 1000).all()
    assert {(i, i) for i, _ in items} <= set(map(tuple, leaks.leaked(numbers, held, vectors).collect()))


def test_items_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_WORDS_AT_ONCE", 15)
    texts = [" ".join(f"{c}{j}" for j in range(12)) for c in "abcde"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert [len(h.ids) for h in leaks.blocks(items)] == [2, 2, 1] and len(list(leaks.blocks(items.where("false")))) == 1


def test_paraphrases_of_short_items(spark):
    words = [f"v{i}" for i in range(12)]
    moved = words[:3] + ["other"] + words[3:]
    numbers, held, vectors = _leaks(spark, [(1, " ".join(moved)), (2, "nothing like it")], [(5, " ".join(words)), (6, " ".join(words[:9]))])
    assert [(r["doc_id"], r["item_id"]) for r in leaks.paraphrased(numbers, held, vectors).collect()] == [(1, 5)]


def test_leak_candidates_come_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(6)
    theirs, own = rng.integers(-3, 4, (60, 4)), rng.integers(-3, 4, (50, 4))
    planes = rng.standard_normal((4, 2))  # few codes, so each has many held-out windows
    codes, code, units = leaks._signs(theirs, planes), leaks._signs(own, planes), leaks._unit(theirs)
    order = np.argsort(codes, kind="stable")
    want = {(i, j) for i in range(50) for j in range(60) if code[i] == codes[j] and (leaks._unit(own)[i] @ units[j] >= 0.5 or not units[j].any())}
    monkeypatch.setattr(leaks, "PAIRS_AT_ONCE", 7)
    parts = list(leaks._candidates(own, code, order, codes[order], units, 0.5))
    assert max(len(w) for w, _ in parts) <= 7 and len(want) > 70
    assert sorted((int(i), int(j)) for w, p in parts for i, j in zip(w, p)) == sorted(want)


def test_leaks_compare_windows_of_equal_vectors_only(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = 1000 + rng.integers(-20, 21, (41, 16))  # common words: all point the same way, so all windows share their signs
    vectors[0] = 0
    held = leaks.HeldOut([], [])
    held.ids, held.words = list(range(20)), [rng.integers(1, 41, 30) for _ in range(20)]
    moved = held.words[3][2:12][::-1]  # an equal vector, but other words
    lists = [*(np.r_[0, rng.integers(1, 41, 40), 0, held.words[i][5:16], 0] for i in range(20)), np.r_[0, moved, 0], np.r_[held.words[0][:6], 0, held.words[0][6:12]], [], [0] * 12]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 100 + len(lists))), pa.array([list(x) for x in lists], pa.list_(pa.int32()))], ["doc_id", "words"])
    compared, candidates = [], leaks._candidates

    def counted(latent, code, order, codes, units, cosine):
        compared.append(int((np.searchsorted(codes, code, "right") - np.searchsorted(codes, code, "left")).sum()))
        return candidates(latent, code, order, codes, units, cosine)

    class Here:
        """Runs the search in this process."""

        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def mapInArrow(self, run, schema):
            self.found = [b for b in run(iter([batch]))]
            return self

        def distinct(self):
            return [pair for b in self.found for pair in zip(*(c.to_pylist() for c in b.columns))]

    monkeypatch.setattr(leaks, "_candidates", counted)
    got = leaks.leaked(Here(), held, vectors)
    assert sorted(got) == [(100 + i, i) for i in range(20)]
    runs, _ = held.windows(10)
    theirs = vectors[runs].sum(axis=1)
    own = [vectors[x[k : k + 10]].sum(axis=0) for x in map(np.array, lists) for k in range(len(x) - 9) if (x[k : k + 10] > 0).all()]
    assert sum(compared) == sum(int((theirs == v).all(axis=1).sum()) for v in own) < 60


def test_pieces_hold_whole_documents_and_few_words(monkeypatch):
    monkeypatch.setattr(leaks, "WORDS_AT_ONCE", 10)
    lists = [[1] * n for n in (4, 6, 1, 0, 25, 3)] + [None, [2] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "words"])
    assert [p.column(0).to_pylist() for p in leaks._pieces([batch])] == [[0, 1], [2, 3], [4], [5, 6], [7]]


def test_leaks_in_disguise_and_empty_inputs(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "x ｏne twο\xa0three fo​ur, FIVE six [[seven]] eight nine ten"), (2, "one two three four five six seven eight nine"), (3, "word")]
    numbers, held, vectors = _leaks(spark, docs, [(7, text), (8, "a b")])
    assert list(map(tuple, leaks.leaked(numbers, held, vectors).collect())) == [(1, 7)]
    numbers, held, vectors = _leaks(spark, docs, [(8, None)])
    assert leaks.leaked(numbers, held, vectors).count() == 0 and leaks.paraphrased(numbers, held, vectors).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    (held,) = leaks.blocks(spark.createDataFrame([(7, text)], "item_id long, text string"))
    numbers = leaks.numbered(empty, held)
    assert leaks.leaked(numbers, held, leaks.latent_words(numbers, leaks.document_weights(numbers, held.size))).count() == 0


def test_paraphrases_find_reordered_passages(spark):
    words = [f"v{i}" for i in range(30)]
    moved = words[:6] + words[8:20] + words[6:8] + words[20:]
    numbers, held, vectors = _leaks(spark, [(1, " ".join(moved)), (2, "nothing like it at all")], [(5, " ".join(words))])
    got = leaks.paraphrased(numbers, held, vectors).collect()
    assert [(r["doc_id"], r["item_id"], r["answer"]) for r in got] == [(1, 5, True)]


def test_paraphrases_match_brute_force(spark, monkeypatch):
    import numpy as np

    for name, value in (("WINDOWS_AT_ONCE", 50), ("ITEMS_AT_ONCE", 3), ("PAIRS_AT_ONCE", 40)):
        monkeypatch.setattr(leaks, name, value, raising=False)
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 45)))) for i in range(10)]
    docs = []
    for i in range(120):
        words = [rng.choice([*vocab, "other"]) for _ in range(rng.randint(0, 30))]
        source = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(source))
            source[at : at + rng.randint(0, 1)] = [rng.choice(["other", *vocab])]
        words[len(words) // 2 : len(words) // 2] = source
        docs.append((i, " ".join(words)))
    numbers, held, vectors = _leaks(spark, docs, items)
    want, close, unit = {}, 0, lambda v: v / max(np.linalg.norm(v), 1e-12)
    for width in (20, 10):
        runs, of = held.windows(width)
        inside = [i for i, p in enumerate(of) if (len(held.words[p]) >= 20) == (width == 20)]
        runs, of = runs[inside], of[inside]
        theirs = np.array([unit(vectors[r].sum(axis=0)) for r in runs])
        for d, text in docs:
            w = np.array([held.number.get(x, 0) for x in text.split()])
            for k in range(len(w) - width + 1):
                for place in np.flatnonzero(theirs @ unit(vectors[w[k : k + width]].sum(axis=0)) >= 0.9):
                    common = leaks.longest_common(w[k : k + width], runs[place])
                    if common >= 0.6 * width:
                        close, key = close + 1, (d, held.ids[of[place]])
                        want[key] = max(want.get(key, 0), int(common))
    got = [(r["doc_id"], r["item_id"], r["common_words"]) for r in leaks.paraphrased(numbers, held, vectors).collect()]
    assert sorted(got) == sorted((*k, c) for k, c in want.items()) and len(want) > 60 and close > 500


def test_longest_common_subsequence():
    import numpy as np

    assert leaks.longest_common(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2
    assert leaks.longest_common(np.array([], int), np.array([1])) == 0
