"""Manifest, phrases and exact search against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import phrases as ph
from factloom.llm.exact_search import Approximations, Search, approximation_file, nearest_by_product
from factloom.llm.merkle import hex_text, leaf_digest, merkle_manifest, path_digest, verified_manifest
from factloom.llm.phrases import collocations

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tagged(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(digests: list[str]) -> tuple[str, list[list[str]]]:
    """Root of a list of digests, and the siblings of each on the way."""
    above = [(d, [i]) for i, d in enumerate(digests)]
    paths = [[] for _ in digests]
    while len(above) > 1:
        pairs = [above[i : i + 2] for i in range(0, len(above), 2)]
        for pair in pairs:
            if len(pair) == 2:
                for mine, other in (pair, pair[::-1]):
                    for leaf in mine[1]:
                        paths[leaf].append(other[0])
        above = [(sha("".join(d for d, _ in p)), [i for _, members in p for i in members]) for p in pairs]
    return above[0][0], paths


def plain_manifest(rows: list[dict]) -> list[tuple]:
    scopes = defaultdict(list)
    for r in rows:
        scopes[r["lang"]].append((r["doc_id"], sha("".join(tagged(r[c]) for c in COLUMNS))))
    trees = {}
    for lang, leaves in scopes.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = climb([d for _, d in leaves])
    names = sorted(scopes, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = climb([trees[lang][0] for lang in names])
    out = []
    for lang, top in zip(names, tops, strict=True):
        for (doc, leaf), path in zip(scopes[lang], trees[lang][1], strict=True):
            out.append((doc, leaf, trees[lang][0], root, sha("".join(path + top))))
    return sorted(out, key=str)


def manifest_of(df, carry=None):
    return merkle_manifest(df, COLUMNS, scope="lang", order="doc_id", carry=carry)


def proofs_of(df) -> list[tuple]:
    digests = [hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    found = manifest_of(df).select("doc_id", *digests, path_digest(F.col("path"), F.col("top_path")))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_manifest_of_odd_rows(odd, empty):
    assert proofs_of(odd) == plain_manifest([r.asDict() for r in odd.collect()])
    assert proofs_of(empty) == []


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, "": 1, None: 1}, {"en": 64, "de": 65, "é": 3}, {"en": 300, "fr": 129, "z": 1, None: 7}])
def test_manifest_of_trees_of_any_depth(spark, sizes):
    rows = [(i * 3 % 401, f"text {i % 50}", lang, "s", i % 5) for lang, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert proofs_of(df) == plain_manifest([r.asDict() for r in df.collect()])


def test_tampering_is_seen(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shown = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0), F.col("text"))
    checked = verified_manifest(manifest_of(df, {"shown": shown}), F.col("shown")).collect()
    assert {r["doc_id"] for r in checked if not r["verified"]} == set(range(3, 100, 10))


def plain_search(rows: list[tuple], asked: set, k: int, scale: float) -> list[tuple]:
    usable = [
        (i, v, [int(np.floor(scale * float(x))) for x in e])
        for i, (v, e) in enumerate(rows)
        if v is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    out = []
    for i, v, e in usable:
        if v in asked:
            scores = sorted((-sum(a * b for a, b in zip(e, o, strict=True)), w) for j, w, o in usable if j != i and len(o) == len(e))
            out += [(v, rank, w, -s) for rank, (s, w) in enumerate(scores[:k], 1)]
    return sorted(out)


ODD_VECTORS = [
    (0, [0.1, -0.2, 0.3]), (50, [0.1, -0.2, 0.3]), (51, [0.1, -0.2, 0.3]), (52, [0.0, 0.0, 0.0]), (53, None), (54, [1.0, None, 0.0]),
    (55, [float("nan"), 0.0, 0.0]), (56, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 1.0]), (57, [-1.0, 1.0]),
    (150, []), (58, []), (200, [5000.0, -5000.0, 5000.0]), (200, [5000.0, -5000.0, 5000.0]), (59, [-300.5, 2.0, 1e-9]), (250, [1.0, 2.0, 3.0, 4.0]),
]


@pytest.mark.parametrize(("tile", "chunk"), [(4096, 1 << 20), (2, 3)])
def test_search_of_odd_vectors(spark, tile, chunk):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD_VECTORS], "vec_id long, embedding array<double>, node string, row int").repartition(3)
    found = nearest_by_product(df, df.where("vec_id % 50 = 0"), k=3, query_tile=tile, chunk=chunk)
    assert sorted(tuple(r) for r in found.collect()) == plain_search(ODD_VECTORS, {0, 50, 100, 150, 200, 250}, 3, 256)
    assert nearest_by_product(df.where("false"), df, k=3).count() == 0


def test_search_among_copies_and_near_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(24)
    rows = [(i, base.tolist()) for i in range(300)]
    rows += [(300 + i, (base + 0.01 * rng.standard_normal(24)).tolist()) for i in range(400)]
    rows += [(700 + i, rng.standard_normal(24).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = {i for i in range(1200) if i % 50 == 0}
    found = nearest_by_product(df, df.where("vec_id % 50 = 0"), query_tile=7, chunk=200)
    assert sorted(tuple(r) for r in found.collect()) == plain_search(rows, asked, 5, 256)


def test_search_reads_few_exact_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 32)) / 5
    rows = [(i, [(i, i)], np.floor(256 * v).astype(int).tolist()) for i, v in enumerate(vectors)]
    classes = spark.createDataFrame(rows, "node long, members array<struct<vec_id:long,row:long>>, ints array<long>")
    file = approximation_file(classes).toArrow().combine_chunks().to_batches()[0]
    search = Search(Approximations(file.slice(0, 20), 32), 5)
    lower, upper = search.bounds(slice(0, 20), Approximations(file, 32))
    ints = np.floor(256 * vectors).astype(np.int64)
    order = file.column("node").to_numpy()
    exact = ints[order[:20]] @ ints[order].T
    assert (lower <= exact).all() and (exact <= upper).all() and (lower < upper).any()
    for start in range(0, 3000, 1000):
        search.add(Approximations(file.slice(start, 1000), 32))
    assert (search.score == -np.sort(-exact, axis=1)[:, :5]).all()
    assert search.read < 0.05 * 20 * 3000


def plain_phrases(rows: list[tuple], least: int, longest: int, covered: int, limit: int) -> list[tuple]:
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    candidates = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    per_lang = defaultdict(list)
    for (lang, words), a in candidates.items():
        cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(
            other[0] == lang and len(other[1]) > len(words) and 100 * n >= covered * a
            and any(other[1][i : i + len(words)] == words for i in range(len(other[1])))
            for other, n in candidates.items()
        )
        if not inside:
            per_lang[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    out = []
    for lang, found in per_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(df, **options) -> list[tuple]:
    return sorted(tuple(r) for r in collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("rate", "longest"), [(0.01, 3), (0.5, 3), (1.0, 4)])
def test_phrases(spark, rng, rate, longest):
    words = [f"w{i}" for i in range(12)] + ["É", "İx", "a.b"]
    rows = [("en" if i % 3 else None, " ".join(rng.choices(words, weights=range(15, 0, -1), k=rng.randrange(40)))) for i in range(150)]
    rows += [("en", "New York  City\tHall, new york city"), ("en", "New York City Hall; of the\nof the")] * 9
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    expected = plain_phrases(rows, 10, longest, 50, 60)
    assert len(expected) > 60
    assert mined(df, longest=longest, rate=rate, limit=60) == expected


def test_phrases_of_odd_rows(odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert mined(odd, least=1) == plain_phrases(rows, 1, 3, 50, 2000)
    assert mined(empty) == []


def test_a_closed_border_takes_no_further_pass(spark, monkeypatch):
    """A sample of everything proposes all that is frequent; one that proposes nothing leaves all to the border."""
    passes = []
    count = ph.counted
    monkeypatch.setattr(ph, "counted", lambda tokens, members, longest: passes.append(len(members)) or count(tokens, members, longest))
    rows = [("en", "one two three four"), ("en", "five six")] * 12
    df = spark.createDataFrame(rows, "lang string, text string")
    whole = ph.frequent_phrases(df, 10, 3, 1.0).frequent.count()
    assert whole == 6 + 4 + 2 and passes == [1, 1]  # one of the sample, one full pass
    passes.clear()
    assert ph.frequent_phrases(df, 10, 3, 0.0).frequent.count() == whole
    assert passes == [1, 1, 2]


def test_words_of_one_hash_get_another_salt(spark, monkeypatch):
    """Under the first salt all words have one hash."""
    tokenized, word_hash = ph.tokenized, ph.word_hash

    def clashing(docs, salt):
        found = tokenized(docs, salt)
        return found if salt else found.withColumn("tokens", F.transform("tokens", lambda t: F.when(t == 0, 0).otherwise(7).cast("long")))

    monkeypatch.setattr(ph, "tokenized", clashing)
    monkeypatch.setattr(ph, "word_hash", lambda salt: word_hash(salt) if salt else F.lit(7).cast("long"))
    df = spark.createDataFrame([("en", "one two one two three")] * 12, "lang string, text string")
    assert mined(df) == plain_phrases([("en", "one two one two three")] * 12, 10, 3, 50, 2000)


def test_hashes_of_words_are_those_of_their_tokens(odd):
    docs = odd.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    for salt in (0, 3):
        stored = ph.tokenized(docs, salt)
        words = {r[0] for r in stored.where("tokens is null").select(ph.word_hash(salt)).collect()}
        tokens = {t for r in stored.where("tokens is not null").collect() for t in r.tokens}
        assert tokens == words | {ph.END}


def test_blocks_of_tokens_lose_nothing(monkeypatch):
    monkeypatch.setattr(ph, "BLOCK_WORDS", 10)
    lists = [[1, 2, 0], [3] * 40 + [0], [4, 0], [5, 0, 6, 0], [7, 0]] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 4], pa.list_(pa.int64()))], ["tokens"]) for i in range(0, len(lists), 4)]
    assert np.concatenate(list(ph._token_blocks(batches))).tolist() == [x for part in lists for x in part]


def test_words_of_blocks():
    texts = pa.array(["Ab, cD\te", "", " \n", "x", "é.É"])
    flat, row, piece = ph.piece_words(texts.slice(0, 5))
    assert (flat.to_pylist(), row.tolist()) == (["ab", "cd", "e", "x", "é", "É"], [0, 0, 0, 3, 4, 4])
    assert np.diff(piece).astype(bool).tolist() == [True, False, True, True, True]
