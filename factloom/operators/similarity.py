"""Pairwise similarity of facts within a tenant and category, without listing the pairs.

What duplicate detection needs is linear in the facts: with how many others a fact is
similar, the sum and the maximum of those similarities, and how the facts connect. So
pairs never leave the task that scores them.

* Facts with an equal title always score 1 with each other. A title group of m copies
  therefore adds m-1 partners of score 1 to each copy: counted, not compared.
* Pairs with different titles need their cosine. Facts are tiled, and one task scores
  two tiles with a matrix product and hands on one row per fact with a partner.
* A (tenant, category) that does not fit one tile is tiled around pivots, and pairs of
  tiles too far apart for the threshold, with the largest bonus, are skipped
  (``pivots``). The only pairs that may pass nevertheless are those of which one title has
  all words of the other: they score a fixed value there, so they are counted per title
  over an index of title words (``all_words_titles``), and those met in tiles are taken off.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.functions.text import title_key, words
from factloom.functions.vectors import norm
from factloom.operators.joins import by_sorting
from factloom.operators.nearest import matrix, rows_by_key, unit_rows
from factloom.operators.ranking import top_k
from factloom.operators.pivots import pivot_tiles
from factloom.operators.tiling import cross_tiles
from factloom.session import materialize

# Fixed values of the title rule.
SAME_TITLE = 1.0
SHARED_WORD_BOOST = 0.25
ALL_WORDS_FLOOR = 0.86
SHORT_WORD = 2
NAME_CATEGORY = "People"

_STEP = 1024
_GROUP = ["user_id", "category"]
_CARRIED = ["user_id", "category", "id", "node", "link", "tiled"]


def recency_pool(facts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most recent facts per tenant and category, ``recency`` 1 = newest."""
    return top_k(facts, ["user_id", "category"], [F.desc("ts"), F.asc("id")], size, rank="recency")


def title_words(key: F.Column) -> F.Column:
    """Distinct words of a title key, none for a missing title."""
    return F.array_distinct(F.coalesce(words(key), F.array().cast("array<string>")))


def similarity_items(facts: DataFrame, vectors: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Facts that can have partners: with a vector of non-zero length.

    ``node`` stands for the title group, named by its smallest id; ``copies`` is the
    size of the group. An untitled fact is a group of its own. ``link`` is what clusters are
    made of: the node, whose facts all reach each other, or the single fact where
    ``threshold`` is above the score of equal titles.
    """
    usable = vectors.where(F.col("embedding").isNotNull()).where(norm("embedding") > 0)
    items = by_sorting(facts.select("user_id", "category", "id", "ts", title_key("title").alias("title_key"))).join(
        usable.select("user_id", "id", "embedding"), ["user_id", "id"]
    )
    titled = F.col("title_key").isNotNull()
    groups = (
        items.where(titled)
        .groupBy("user_id", "category", "title_key")
        .agg(F.min("id").alias("_first"), F.count("*").alias("_copies"))
    )
    return (
        items.join(groups, ["user_id", "category", "title_key"], "left")
        .withColumn("node", F.coalesce("_first", "id"))
        .withColumn("copies", F.coalesce("_copies", F.lit(1)))
        .withColumn("titled", titled)
        .withColumn("link", F.col("node") if threshold <= SAME_TITLE else F.col("id"))
        .withColumn("words", title_words(F.col("title_key")))
        .select("user_id", "category", "id", "ts", "node", "copies", "titled", "link", "words", "embedding")
    )


class TitledVectors:
    """Facts of one tenant and category as a matrix, with their titles as class numbers.

    Facts with an equal title share a class; those without a title share one, too, which
    is equal to nothing. Facts often share titles, so words are compared per class.
    """

    def __init__(self, table: pa.Table | pa.RecordBatch):
        self.ids = table.column("id")
        self.units = unit_rows(matrix(table.column("embedding")))
        titled = np.array(table.column("titled").to_pylist(), dtype=bool)
        nodes = np.array(table.column("node").to_pylist(), dtype=object)
        self.titles, first, codes = np.unique(nodes[titled], return_index=True, return_inverse=True)
        self.kind = np.full(len(titled), len(self.titles))
        self.kind[titled] = codes
        places = np.nonzero(titled)[0][first]
        self.words = [*table.column("words").take(pa.array(places)).to_pylist(), []]

    def __len__(self) -> int:
        return len(self.kind)


def _shared_ratio(left: list[list[str]], right: list[list[str]], names: bool) -> np.ndarray:
    """Share of the shorter title's words that two titles have in common, counting words only."""
    counts = np.zeros((len(left), len(right)))
    postings: dict[str, list[int]] = defaultdict(list)
    for j, tokens in enumerate(right):
        for token in tokens:
            if names or len(token) > SHORT_WORD:
                postings[token].append(j)
    for i, tokens in enumerate(left):
        for token in tokens:
            counts[i, postings.get(token, [])] += 1
    left_sizes = np.array([len(w) for w in left])[:, None]
    right_sizes = np.array([len(w) for w in right])[None, :]
    return counts / np.maximum(np.minimum(left_sizes, right_sizes), 1)


def passing_pairs(
    a: TitledVectors, b: TitledVectors, threshold: float, names: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs with different titles that score at least ``threshold``: rows of a, rows of b, scores, and whether one
    title has all words of the other.

    The score is the cosine plus a bonus for shared title words. Only pairs whose cosine
    can still pass with the largest bonus at hand, or that have all words in common, are
    scored one by one.
    """
    b_kinds, b_code = np.unique(b.kind, return_inverse=True)
    b_words = [b.words[k] for k in b_kinds]
    b_titles = np.array([*b.titles, None], dtype=object)[b_kinds]
    for start in range(0, len(a), _STEP):
        cosines = a.units[start : start + _STEP] @ b.units.T
        kinds, code = np.unique(a.kind[start : start + _STEP], return_inverse=True)
        ratio = _shared_ratio([a.words[k] for k in kinds], b_words, names)
        titles = np.array([*a.titles, None], dtype=object)[kinds]
        place = {title: n for n, title in enumerate(b_titles) if title is not None}
        equal = np.zeros(ratio.shape, dtype=bool)
        for n, title in enumerate(titles):
            if title in place:
                equal[n, place[title]] = True
        ratio[equal] = 0.0
        candidates = cosines >= threshold - SHARED_WORD_BOOST * ratio.max() - 1e-9
        complete = ratio >= 1.0
        if threshold <= ALL_WORDS_FLOOR and complete.any():
            candidates |= complete[code][:, b_code]
        i, j = np.nonzero(candidates)
        share = ratio[code[i], b_code[j]]
        score = cosines[i, j] + SHARED_WORD_BOOST * share
        score = np.where(share >= 1.0, np.maximum(score, ALL_WORDS_FLOOR), score)
        keep = (score >= threshold) & ~equal[code[i], b_code[j]]
        yield start + i[keep], j[keep], score[keep], share[keep] >= 1.0


def _smallest_reachable(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node each of ``count`` nodes reaches over the links a-b."""
    label = np.arange(count)
    while True:
        lowest = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, lowest)
        np.minimum.at(label, b, lowest)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _score_tiles(table: pa.Table, threshold: float) -> pa.Table:
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    names = table.column("category")[0].as_py() == NAME_CATEGORY
    place = table.column("tile").to_pylist()
    left = np.array([n for n, tile in enumerate(place) if tile == low], dtype=np.int64)
    right = left if low == high else np.array([n for n, tile in enumerate(place) if tile == high], dtype=np.int64)
    a = TitledVectors(table.take(pa.array(left)))
    b = a if low == high else TitledVectors(table.take(pa.array(right)))
    links = table.column("link").to_pandas().to_numpy()
    link_values, link = np.unique(links, return_inverse=True)

    n = table.num_rows
    partners, lifted = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    total, best = np.zeros(n), np.full(n, -np.inf)
    linked = [np.empty((0, 2), dtype=np.int64)]
    for i, j, score, complete in passing_pairs(a, b, threshold, names):
        i, j = left[i], right[j]
        if low == high:
            once = i < j
            i, j, score, complete = i[once], j[once], score[once], complete[once]
        for side in (i, j):
            partners += np.bincount(side, minlength=n)
            lifted += np.bincount(side[complete], minlength=n)
            total += np.bincount(side, weights=score, minlength=n)
            np.maximum.at(best, side, score)
        linked.append(np.unique(np.stack([link[i], link[j]], axis=1), axis=0))
    pairs = np.concatenate(linked)
    root = _smallest_reachable(len(link_values), pairs[:, 0], pairs[:, 1])
    (members,) = np.nonzero(partners)
    taken = table.select(_CARRIED).take(pa.array(members))
    roots = pa.array(link_values[root[link[members]]].tolist(), table.schema.field("link").type)
    extra = [roots, pa.array(partners[members]), pa.array(total[members]), pa.array(best[members]), pa.array(lifted[members])]
    return pa.table([*taken.columns, *extra], names=[*taken.column_names, "root", "partners", "total", "best", "lifted"])


def cross_title_evidence(items: DataFrame, threshold: float, tile_rows: int = 8192) -> DataFrame:
    """Partner counts and links among facts with different titles.

    A fact may have several rows, which add up. ``root`` is a smaller or equal link that ``link``
    reaches; where ``tiled`` is false, the facts of the group were scored together and the roots are final.
    """
    columns = ["id", "node", "titled", "link", "words", "embedding", "copies"]
    sizes = items.groupBy(*_GROUP).agg((F.count("*") > tile_rows).alias("tiled"))
    sized = items.select(*_GROUP, *columns).join(materialize(sizes, "group-sizes"), _GROUP)
    alone = sized.where("not tiled").withColumns({c: F.lit(0) for c in ("tile", "low", "high")})
    found = _scored(alone, threshold)
    if not sizes.where("tiled").take(1):
        return found.drop("node", "lifted")
    large = materialize(sized.where("tiled"), "large-groups")
    tiles = pivot_tiles(large, _GROUP, "id", tile_rows, threshold - SHARED_WORD_BOOST)
    scored = materialize(_scored(tiles, threshold), "scored-tiles", plain=True)
    if threshold <= ALL_WORDS_FLOOR:
        scored = scored.unionByName(_unmet(large, scored))
    return found.unionByName(scored).drop("node", "lifted")


def _scored(tiled: DataFrame, threshold: float) -> DataFrame:
    return tiled.groupBy(*_GROUP, "low", "high").applyInArrow(
        lambda table: _score_tiles(table, threshold), _evidence_schema(tiled)
    )


def all_words_titles(items: DataFrame) -> DataFrame:
    """Pairs of titles of which the first has only words that count, all of them words of the second:
    group + [a, b, a_copies, b_copies], named by node, each pair once.

    Every title is looked up by its rarest word, so a word that very many titles have is only
    followed for titles that have no other."""
    names = F.col("category") == NAME_CATEGORY
    titles = items.where(F.col("titled")).groupBy(*_GROUP, "node").agg(F.first("words").alias("words"), F.count("*").alias("copies"))
    titles = materialize(titles, "titles", plain=True)
    counting = F.forall("words", lambda w: F.length(w) > SHORT_WORD) | names
    entries = titles.select(*_GROUP, "node", "words", "copies", (counting & (F.size("words") > 0)).alias("counting"), F.explode("words").alias("word"))
    common = entries.groupBy(*_GROUP, "word").agg(F.count("*").alias("titles"))
    short = entries.where("counting").join(common, [*_GROUP, "word"]).groupBy(*_GROUP, "node")
    short = short.agg(
        F.min_by("word", F.struct("titles", "word")).alias("word"), F.first("words").alias("short"), F.first("copies").alias("a_copies")
    ).withColumnRenamed("node", "a")
    pairs = entries.join(materialize(short, "short-titles", plain=True), [*_GROUP, "word"]).where(F.col("node") != F.col("a"))
    pairs = pairs.where(F.size(F.array_except("short", "words")) == 0)
    # Titles with the same words in another order would be found from both sides.
    pairs = pairs.where((F.size("short") < F.size("words")) | (F.col("a") < F.col("node")))
    return pairs.select(*_GROUP, "a", F.col("node").alias("b"), "a_copies", F.col("copies").alias("b_copies"))


def _unmet(items: DataFrame, scored: DataFrame) -> DataFrame:
    """Evidence of pairs with all words in common that no tile brought together: their cosine is too low
    to count, so each scores ALL_WORDS_FLOOR. ``scored`` tells how many of a fact's pairs were met."""
    pairs = materialize(all_words_titles(items), "all-words-titles", plain=True)
    sides = [pairs.select(*_GROUP, F.col(x).alias("node"), F.col(y).alias("other"), F.col(f"{y}_copies").alias("n")) for x, y in ("ab", "ba")]
    counts = sides[0].unionByName(sides[1]).groupBy(*_GROUP, "node")
    counts = counts.agg(F.sum("n").alias("n"), F.min("other").alias("lowest"))
    met = scored.groupBy(*_GROUP, "id").agg(F.sum("lifted").alias("met"))
    facts = items.where("titled").select(*_CARRIED).join(counts, [*_GROUP, "node"]).join(met, [*_GROUP, "id"], "left")
    left = F.col("n") - F.coalesce("met", F.lit(0))
    # With equal titles in one class, links are nodes: a title reaches the smallest of its partners, and these their own.
    unmet = facts.select(
        *_CARRIED,
        F.least("link", "lowest").alias("root"),
        left.cast("long").alias("partners"),
        (left * F.lit(ALL_WORDS_FLOOR)).alias("total"),
        F.when(left > 0, F.lit(ALL_WORDS_FLOOR)).otherwise(F.lit(float("-inf"))).alias("best"),
        F.lit(0).cast("long").alias("lifted"),
    )
    # Links of the pairs themselves: a row without partners of its own, for one fact of each title.
    first = items.where("titled").groupBy(*_GROUP, "node").agg(F.min("id").alias("id"))
    links = pairs.select(*_GROUP, F.col("a").alias("node"), F.col("b").alias("root")).join(first, [*_GROUP, "node"])
    links = links.select(
        *_GROUP, "id", "node", F.col("node").alias("link"), F.lit(True).alias("tiled"), "root",
        F.lit(0).cast("long").alias("partners"), F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("best"), F.lit(0).cast("long").alias("lifted"),
    )
    return unmet.unionByName(links)


def _evidence_schema(tiled: DataFrame) -> T.StructType:
    return T.StructType(
        [
            *[tiled.schema[name] for name in _CARRIED],
            T.StructField("root", tiled.schema["link"].dataType),
            T.StructField("partners", T.LongType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("best", T.DoubleType()),
            T.StructField("lifted", T.LongType()),
        ]
    )


class _Tally:
    """Partners of each fact of one side, summed up over the sides it is scored against."""

    def __init__(self, side: TitledVectors, names: bool):
        self.side, self.names = side, names
        self.partners = np.zeros(len(side), dtype=np.int64)
        self.total = np.zeros(len(side))
        self.best = np.full(len(side), -np.inf)

    def add(self, other: TitledVectors, threshold: float) -> None:
        for i, _, score, _ in passing_pairs(self.side, other, threshold, self.names):
            self.partners += np.bincount(i, minlength=len(self.side))
            self.total += np.bincount(i, weights=score, minlength=len(self.side))
            np.maximum.at(self.best, i, score)
        if threshold <= SAME_TITLE:
            sizes = dict(zip(other.titles, np.bincount(other.kind, minlength=len(other.titles))))
            copies = np.array([*[sizes.get(title, 0) for title in self.side.titles], 0])[self.side.kind]
            self.partners += copies
            self.total += copies * SAME_TITLE
            self.best = np.where(copies > 0, np.maximum(self.best, SAME_TITLE), self.best)

    def rows(self, user: object, category: object, schema: pa.Schema) -> pa.RecordBatch:
        (found,) = np.nonzero(self.partners)
        keys = [[value] * len(found) for value in (user, category)]
        ids = self.side.ids.take(pa.array(found)).to_pylist()
        values = [*keys, ids, self.partners[found], self.total[found], self.best[found]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


_ITEM = [*_GROUP, "id", "node", "titled", "words", "embedding"]


def evidence_against(
    new: DataFrame,
    known: DataFrame,
    threshold: float,
    broadcast_bytes: int = 64 << 20,
    broadcast_rows: int = 20_000,
    tile_rows: int = 8192,
) -> DataFrame:
    """Partners of ``new`` items among ``known`` items of equal tenant and category.

    Items carry user_id, category, id, node, titled, words, embedding; equal nodes of
    titled items are equal titles. A new item may have several rows: user_id, category, id, partners, total, best.

    New items within the bounds go to every task and the known ones are scanned where
    they lie; more of them are tiled on both sides.
    """
    new, known = new.select(*_ITEM), known.select(*_ITEM)
    fields = [new.schema[name] for name in _ITEM[:3]]
    out = T.StructType(
        [
            *fields,
            T.StructField("partners", T.LongType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("best", T.DoubleType()),
        ]
    )
    arrow_out = to_arrow_schema(out)
    head = new.limit(broadcast_rows + 1).toArrow()
    if head.num_rows <= broadcast_rows and head.nbytes <= broadcast_bytes:
        groups = set(zip(*(head.column(name).to_pylist() for name in _GROUP)))
        blocks = {key: TitledVectors(part) for key, part in rows_by_key(head, _GROUP, groups)}
        shared = known.sparkSession.sparkContext.broadcast(blocks)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tallies: dict[tuple, _Tally] = {}
            for batch in batches:
                for key, part in rows_by_key(batch, _GROUP, shared.value):
                    if key not in tallies:
                        tallies[key] = _Tally(shared.value[key], key[1] == NAME_CATEGORY)
                    tallies[key].add(TitledVectors(part), threshold)
            for key, tally in tallies.items():
                yield tally.rows(*key, arrow_out)

        return known.mapInArrow(scan, out)

    left, right = cross_tiles(new, known, _GROUP, "id", "id", tile_rows)
    keys = [*_GROUP, "l_tile", "r_tile"]

    def score(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if mine.num_rows == 0 or theirs.num_rows == 0:
            return arrow_out.empty_table()
        user, category = mine.column("user_id")[0].as_py(), mine.column("category")[0].as_py()
        tally = _Tally(TitledVectors(mine), category == NAME_CATEGORY)
        tally.add(TitledVectors(theirs), threshold)
        return pa.Table.from_batches([tally.rows(user, category, arrow_out)])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, out)
