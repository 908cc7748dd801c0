"""SentencePiece pieces, periodic runs and the Merkle manifest against the library, brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gradeloom.llm import merkle, periodic_runs, pieces
from gradeloom.llm.queries import PIECES, QUERIES, with_planted_runs
from tests.llm.test_operators import BIG, CLASHING, EDGES, docs, edge_docs, empty_docs, table

BY_NAME = {q.name: q for q in QUERIES}


# 11: SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECES)


def ids_of(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


@pytest.mark.parametrize("letters", ["ab ", "the andig ", "aeiou tn", "\n\t é日本 ﬁ①▁x", "<0x41>", "══ ", "12.,"])
def test_pieces_of_drawn_texts(model, library, letters):
    draw = random.Random(letters)
    for _ in range(800):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        assert ids_of(model, text) == library.encode(text), text


def test_pieces_of_joined_pieces_and_ties(model, library):
    draw, known = random.Random(3), list(model.score)
    for _ in range(5_000):
        text = "".join(draw.choices(known, k=draw.randint(0, 6))).replace(pieces.SPACE, " ")
        assert ids_of(model, text) == library.encode(text), text
    for n in range(60):  # all pieces of spaces have one score
        for text in (" " * n, "a" + " " * n + "b", "a" * n):
            assert ids_of(model, text) == library.encode(text)
    long = "ab" * 20_000 + " " * 20_000 + "日" * 500
    assert ids_of(model, long) == library.encode(long)


def test_uncut_texts_give_the_same(model, library):
    """The cut saves work only: whole texts as one chunk have the same pieces."""
    draw = random.Random(5)
    for _ in range(500):
        text = "".join(draw.choices("the and, .日é\n ", k=draw.randint(1, 60)))
        whole = model.ids_of_chunk(pieces.SPACE + text.replace(" ", pieces.SPACE))
        assert np.frombuffer(whole, "<i4").tolist() == library.encode(text)


def test_decode_of_any_ids(model, library):
    draw = random.Random(7)
    for _ in range(5_000):
        ids = [draw.choice([draw.randrange(32_000), draw.randrange(3), draw.randrange(3, 259)])
               for _ in range(draw.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_few_remembered_give_the_same(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_REMEMBERED", 3)
    monkeypatch.setattr(pieces, "PAIRS_REMEMBERED", 3)
    small, draw = pieces.Pieces(PIECES), random.Random(9)
    for _ in range(300):
        text = "".join(draw.choices("there and then ", k=50))
        assert ids_of(small, text) == library.encode(text)


def test_pieces_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, BIG, "documents").collect()}
    got = {r["doc_id"]: r for r in BY_NAME["op11_sentence_pieces"].run(spark, BIG).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_edges(spark, library):
    got = pieces.decode(pieces.encode(edge_docs(spark), PIECES), PIECES).collect()
    wanted = sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in EDGES)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == wanted
    assert pieces.encode(empty_docs(spark), PIECES).count() == 0
    nothing = spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids array<int>")
    assert pieces.decode(nothing, PIECES).first()["decoded"] == ""


# 12: periodic runs


def brute_runs(words):
    """(start, end, period) of all runs, by trying every period at every word."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(texts):
    return [list(zip(*[c.tolist() for c in runs])) for runs in periodic_runs.runs_of_texts(texts)]


def drawn_words(draw):
    letters, words = "abcdefghij"[: draw.randint(1, 10)], []
    while len(words) < draw.randint(0, 60):
        if draw.random() < 0.6:
            root = draw.choices(letters, k=draw.randint(1, 9))
            words += (root * draw.randint(1, 9))[: draw.randint(1, 60)]
        else:
            words += draw.choices(letters, k=draw.randint(1, 8))
    return words


def test_runs_of_drawn_texts():
    draw = random.Random(1)
    for _ in range(150):
        texts = [drawn_words(draw) for _ in range(draw.randint(1, 30))]
        assert runs_of(texts) == [brute_runs(t) for t in texts]


def test_runs_within_runs():
    draw = random.Random(2)
    for _ in range(200):
        root = draw.choices("ab", k=draw.randint(1, 4)) * draw.randint(4, 8) + draw.choices("abc", k=draw.randint(0, 3))
        words = root * draw.randint(3, 8) + draw.choices("abc", k=3)
        assert runs_of([words])[0] == brute_runs(words)


def test_grammar_derives_its_text():
    draw = random.Random(4)
    codes = np.array(draw.choices(range(4), k=500))
    grammar = periodic_runs.Grammar(codes, np.repeat([0, 1], 250))

    def derived(symbol):
        if symbol < grammar.words:
            return [symbol]
        i = symbol - grammar.words
        return derived(grammar.left[i]) + derived(grammar.right[i])

    assert len(grammar.roots) == 2
    assert derived(grammar.roots[0]) + derived(grammar.roots[1]) == codes.tolist()
    for symbol in range(grammar.words, len(grammar.size)):
        at = grammar.at[symbol]
        assert derived(symbol) == codes[at : at + grammar.size[symbol]].tolist()


def test_runs_of_very_long_texts():
    assert runs_of([["a"] * 300_000]) == [[(0, 300_000, 1)]]
    root = random.Random(3).choices([str(i) for i in range(1000)], k=20_000)
    assert runs_of([root * 5]) == [[(0, 100_000, 20_000)]]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").collect()
    got = {r["doc_id"]: r for r in BY_NAME["op12_periodic_runs"].run(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    seen = 0
    for r in rows:
        words = planted(r["doc_id"], periodic_runs.WORD.findall(r["text"] or ""))
        if len(words) > 3_000:
            continue
        runs, g = brute_runs(words), got[r["doc_id"]]
        assert g["n_runs"] == len(runs)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        assert g["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs)]
        assert g["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        best = min(((s - e, s, q) for s, e, q in runs), default=None)
        if best is None:
            assert [g[c] for c in ("start", "length", "period", "exponent_milli")] == [None] * 4
        else:
            size, start, q = -best[0], best[1], best[2]
            seen += 1
            assert [g[c] for c in ("start", "length", "period", "exponent_milli")] == [start, size, q, 1000 * size // q]
    assert seen


def test_runs_edges(spark):
    got = periodic_runs.find_runs(edge_docs(spark)).collect()
    assert len(got) == len(EDGES)
    rows = {r["doc_id"]: r for r in got}
    assert rows[8]["runs"] == [] and rows[9]["collapsed"] == "" and rows[7]["collapsed"] == ""
    assert rows[10]["collapsed"] == "a\xa0b\x1cc d"
    assert [tuple(r) for r in rows[1]["runs"]] == [(0, 30_000 * 9, 9)]
    assert rows[1]["collapsed"] == "Word of a very long text, 12.5 and more!"
    assert periodic_runs.find_runs(empty_docs(spark)).count() == 0
    assert with_planted_runs(edge_docs(spark)).count() == len(EDGES)


# 13: Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """(root, per leaf its steps) of one tree."""
    level, at = list(leaves), list(range(len(leaves)))
    steps = [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place - place % 8 : place - place % 8 + 8]
            steps[i].append((place % 8, run[: place % 8] + run[place % 8 + 1 :]))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [place // 8 for place in at]
    return level[0], steps


@pytest.mark.parametrize("levels, counts", [
    (1, [1, 65, 700]), (1, [513, 64, 8, 1, 1, 1, 1, 1, 1]), (2, [1]), (2, [9]), (2, [4609]), (4, [8, 700]), (4, [4609])])
def test_exchange_gives_whole_proofs(spark, levels, counts):
    rows = [(t or None, i, sha(f"{t}:{i}")) for t, n in enumerate(counts) for i in range(n)]
    random.Random(0).shuffle(rows)
    given = spark.createDataFrame(rows, "tree int, id long, leaf string")
    got = merkle.prove(given, ["id"], block_levels=levels).collect()
    assert len(got) == len(rows)
    trees = {t or None: brute_tree([sha(f"{t}:{i}") for i in range(n)]) for t, n in enumerate(counts)}
    root, tops = brute_tree([trees[t or None][0] for t in range(len(counts))])
    for r in got:
        subroot, steps = trees[r["tree"]]
        assert (r["subroot"], r["root"]) == (subroot, root)
        wanted = steps[r["id"]] + tops[r["tree"] or 0]
        assert [(s["at"], s["others"]) for s in r["proof"]] == wanted


def test_altered_leaves_are_found(spark, sf_dir):
    rows = BY_NAME["op13_merkle_manifest"].run(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    wrong = {r["doc_id"] for r in rows if not r["verified"]}
    lowered = "".maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert wrong == {i for i, t in texts.items()
                     if t and zlib.crc32(str(i).encode()) % 3 == 0 and t.translate(lowered) != t}


def test_manifest_edges(spark):
    got = merkle.manifest(edge_docs(spark), extra={"text_": F.col("text")})
    rows = got.withColumn("up", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == len(EDGES) and all(r["up"] == r["root"] for r in rows)
    assert len({r["root"] for r in rows}) == 1
    by_id = {r["doc_id"]: r["leaf"] for r in rows}
    assert by_id[8] == sha("1:82:s2--0:") and by_id[9] == sha("1:92:s0---")
    assert merkle.manifest(empty_docs(spark)).count() == 0
    one = docs(spark, [(1, "a")], CLASHING)
    only = merkle.manifest(one).first()
    assert only["root"] == only["leaf"] == only["subroot"] and only["proof"] == []


def test_copies_spread_over_partitions(spark):
    """A third of all rows are equal: range partitioning still cuts them."""
    given = docs(spark, [(7, "same")] * 900 + [(i, f"t{i}") for i in range(600)])
    rows = merkle.manifest(given)
    assert rows.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 1_500
    placed = merkle._ordered(given.select(F.col("doc_id").alias("id"), F.lit(1).alias("tree"),
                                          F.md5("text").alias("leaf")), ["id"])
    assert sorted(r["place"] for r in placed.collect()) == list(range(1_500))


def test_arrow_layout_of_runs():
    """Slices of runs keep their own offsets."""
    found = periodic_runs.runs_of_texts([["x"] * 6, [], ["a", "b"] * 4])
    assert [len(r[0]) for r in found] == [1, 0, 1]
    assert pa.array([r[2].tolist() for r in found]).to_pylist() == [[1], [], [2]]
