"""Language identification: scripts narrow the candidates, a Viterbi search labels spans of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import carried, coded, text_blocks, words
from factloom.session import materialize

#: First and last code point of the main blocks of scripts (fixed values of Unicode); others are script 0.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
]
_NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]
_FIRST = np.array([a for a, _, _ in SCRIPTS])
_LAST = np.array([b for _, b, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, _, name in SCRIPTS])

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
LONG_TEXT = 1500
#: Bytes of text worked on at once: scores take a double for each word and language.
BLOCK = 1_500_000
UNDETERMINED = "und"


def scripts_of(points: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_FIRST, points, side="right") - 1
    inside = (at >= 0) & (points <= _LAST[at])
    return np.where(inside, _SCRIPT[at], 0)


@dataclass
class Features:
    """Of distinct words: letters and script of each, and hashed character n-grams as (word, bucket)."""

    letters: np.ndarray
    script: np.ndarray
    word: np.ndarray
    bucket: np.ndarray


def word_features(strings: list[str]) -> Features:
    n = len(strings)
    points = np.frombuffer((" " + " ".join(s.lower() for s in strings) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = points == 32
    owner = np.cumsum(space) - 1
    distinct, codes = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in distinct.tolist()], bool)[codes]
    letters = np.bincount(owner[letter], minlength=n)[:n] if n else np.zeros(0, np.int64)
    script = np.zeros(n, np.int64)
    kinds = scripts_of(points[letter].astype(np.int64))
    votes = np.bincount(owner[letter] * len(_NAMES) + kinds, minlength=n * len(_NAMES))[: n * len(_NAMES)]
    if n:
        script = votes.reshape(n, len(_NAMES)).argmax(1)
    word, bucket = [], []
    mixed = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for order in ORDERS:
        if len(points) < order:
            continue
        h = np.full(len(points) - order + 1, order, np.uint64)
        for k in range(order):
            h = (h ^ mixed[k : len(points) - order + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        # A space may stand at the ends of an n-gram (start or end of the word), not within.
        inner = np.zeros(len(h), bool)
        for k in range(1, order - 1):
            inner |= space[k : len(points) - order + 1 + k]
        edge = space[: len(h)] & space[order - 1 : order - 1 + len(h)]
        fine = np.flatnonzero(~inner & ~edge)
        word.append(owner[fine])
        bucket.append((h[fine] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return Features(letters, script, np.concatenate(word), np.concatenate(bucket))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages): log probability of an n-gram, relative to the mean language
    candidates: np.ndarray  # (scripts, languages)

    def word_scores(self, f: Features) -> np.ndarray:
        """Score of each word for each language; languages that do not use its script are out."""
        n = len(f.letters)
        scores = np.zeros((n, len(self.languages)))
        for k in range(len(self.languages)):
            scores[:, k] = np.bincount(f.word, self.weights[f.bucket, k], minlength=n)[:n] / len(ORDERS)
        allowed = self.candidates[f.script]
        open_word = ~allowed.any(1)
        scores[open_word] = 0.0
        return np.where(allowed | open_word[:, None], scores, -50.0)


def learn_languages(labelled: DataFrame, per_language: int = 2000, script_share: float = 0.01) -> LanguageModel:
    """Fit n-gram weights and script use on about ``per_language`` documents of each language.

    ``labelled`` has text and lang; rows where either is null are left out. The sample is drawn by a hash of
    the text, at a rate from the language's count, so it is the same on every run and spread over the
    table. What reaches the driver is one row per language and bucket, at most BUCKETS for a language.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # One row per language, stored so that its size is known: then texts are drawn where they are read.
    rate = materialize(counts.select("lang", (F.lit(per_language * 2.0**32) / F.col("n")).alias("rate")), "rate")
    sample = rows.join(rate, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < F.col("rate")).select("text", "lang")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK):
            flat, row = words(block.column("__text"))
            if not len(flat):
                continue
            codes, distinct = coded(flat)
            f = word_features(distinct.to_pylist())
            labels, langs = coded(block.column("lang"))
            label = labels[row]
            # Weight of each (language, distinct word), then of each (language, bucket) and (language, script).
            pairs, times = np.unique(label * len(distinct) + codes, return_counts=True)
            for k, lang in enumerate(langs.to_pylist()):
                mine = pairs // len(distinct) == k
                weight = np.bincount(pairs[mine] % len(distinct), times[mine], minlength=len(distinct))
                grams = np.bincount(f.bucket, weight[f.word], minlength=BUCKETS)
                script = np.bincount(f.script, weight * f.letters, minlength=len(_NAMES))
                slot = np.concatenate([np.flatnonzero(grams), BUCKETS + np.flatnonzero(script)])
                value = np.concatenate([grams[grams > 0], script[script > 0]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(slot), pa.string()), pa.array(slot), pa.array(value)], ["lang", "slot", "n"]
                )

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, slot long, n double")
    table = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique().tolist())
    full = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    full[table["slot"].to_numpy(int), table["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(int)] = table["n"]
    grams, script = full[:BUCKETS] + 0.5, full[BUCKETS:]
    log = np.log(grams / grams.sum(0))
    weights = (log - log.mean(1, keepdims=True)).astype(np.float32) if languages else log.astype(np.float32)
    return LanguageModel(languages, weights, script > script_share * script.sum(0))


def _one_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of one long text."""
    n, size = scores.shape
    state = scores[0].tolist()
    back = np.empty((n, size), np.int16)
    kinds = range(size)
    for t, row in enumerate(scores.tolist()):
        if not t:
            continue
        top = max(kinds, key=state.__getitem__)
        jump = state[top] - penalty
        back[t] = [k if state[k] >= jump else top for k in kinds]
        state = [max(state[k], jump) + row[k] for k in kinds]
    labels = np.empty(n, np.int16)
    now = max(kinds, key=state.__getitem__)
    for t in range(n - 1, -1, -1):
        labels[t] = now
        now = back[t, now]
    return labels


def label_spans(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Language index of each word: the best path per text, where each switch costs ``penalty``.

    All texts advance together, one word at a time; few long ones would leave that loop nearly empty
    and are walked alone."""
    size = scores.shape[1]
    starts = np.cumsum(lengths) - lengths
    labels = np.empty(len(scores), np.int16)
    for i in np.flatnonzero(lengths > LONG_TEXT):
        labels[starts[i] : starts[i] + lengths[i]] = _one_path(scores[starts[i] : starts[i] + lengths[i]], penalty)
    short = np.flatnonzero((lengths > 0) & (lengths <= LONG_TEXT))
    short = short[np.argsort(-lengths[short], kind="stable")]
    if not len(short):
        return labels
    start, length = starts[short], lengths[short]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t
    top_at, stay = np.zeros(len(scores), np.int16), np.zeros((len(scores), size), bool)
    final = np.zeros(len(short), np.int64)
    state = scores[start]
    for t in range(1, steps):
        n = active[t]
        if n < len(state):
            final[n : len(state)] = state[n:].argmax(1)
            state = state[:n]
        at = start[:n] + t
        top = state.argmax(1)
        jump = (state[np.arange(n), top] - penalty)[:, None]
        stay[at], top_at[at] = state >= jump, top
        state = np.maximum(state, jump) + scores[at]
    final[: len(state)] = state.argmax(1)
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        at = start[: active[t]] + t
        here = now[: active[t]]
        labels[at] = here
        now[: active[t]] = np.where(stay[at, here], here, top_at[at])
    return labels


def identify_languages(
    docs: DataFrame, model: LanguageModel, penalty: float = 8.0, carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``carry`` with lang_pred, score and spans for every row of ``docs``, which has text.

    Words vote by the n-grams they are made of; the script of a word rules out languages that hardly
    use it. The best labelling with ``penalty`` for each switch gives spans (lang, first_word, n_words;
    words without letters count on with the word before). lang_pred is the language of most letters and
    score their share. Texts that are null or have no letter are "und" with score 0 and no spans; so is
    everything if no language was learned. Copies get equal answers; nothing is shuffled. Only the text
    decides; columns that are not carried, as lang and source, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [*model.languages, UNDETERMINED]
        for block in text_blocks(batches, limit=BLOCK):
            n = len(block)
            flat, row = words(block.column("__text"))
            best, share = np.full(n, len(names) - 1), np.zeros(n)
            span_row = span_first = span_size = span_lang = np.zeros(0, np.int64)
            if len(flat) and model.languages:
                codes, distinct = coded(flat)
                f = word_features(distinct.to_pylist())
                spoken = np.flatnonzero(f.letters[codes] > 0)
                lengths = np.bincount(row[spoken], minlength=n)
                labels = label_spans(model.word_scores(f)[codes[spoken]], lengths, penalty)
                weight = f.letters[codes[spoken]]
                size = len(names)
                mass = np.bincount(row[spoken] * size + labels, weight, minlength=n * size).reshape(n, size)
                heard = mass.sum(1) > 0
                best[heard] = mass[heard].argmax(1)
                share[heard] = mass[heard].max(1) / mass[heard].sum(1)
                here = row[spoken]
                change = np.ones(len(spoken), bool)
                change[1:] = (here[1:] != here[:-1]) | (labels[1:] != labels[:-1])
                cut = np.flatnonzero(change)
                counts = np.bincount(row, minlength=n)
                text_start = (np.cumsum(counts) - counts)[here[cut]]
                span_row, span_lang = here[cut], labels[cut].astype(np.int64)
                lead = np.ones(len(cut), bool)
                lead[1:] = span_row[1:] != span_row[:-1]
                span_first = np.where(lead, 0, spoken[cut] - text_start)
                follow = np.append(span_first[1:], 0)
                last = np.append(lead[1:], True) if len(cut) else lead
                span_size = np.where(last, counts[span_row], follow) - span_first
            spans = pa.StructArray.from_arrays(
                [pa.array(names).take(pa.array(span_lang)), pa.array(span_first), pa.array(span_size)], ["lang", "first_word", "n_words"]
            )
            offsets = np.concatenate([[0], np.cumsum(np.bincount(span_row, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *[block.column(c) for c in carry],
                    pa.array(names).take(pa.array(best)),
                    pa.array(share),
                    pa.ListArray.from_arrays(pa.array(offsets), spans),
                ],
                [*carry, "lang_pred", "score", "spans"],
            )

    schema = f"{carried(docs, carry)}, lang_pred string, score double, spans array<struct<lang string, first_word long, n_words long>>"
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)
