"""Operators on texts against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from factloom.llm import licenses, outliers, pieces, simhash
from factloom.llm.blocks import text_blocks
from factloom.llm.language import identify_languages, label_spans, learn_languages
from factloom.llm.licenses import scan_licenses
from factloom.llm.lines import drop_common_lines
from factloom.llm.outliers import judge_documents
from factloom.llm.pieces import decode_pieces, encode_pieces, load_model, piece_digests
from factloom.llm.queries import ORACLE_SQL
from factloom.llm.simhash import simhash_groups
from factloom.llm.token_files import WordEncoder, read_token_files, token_digests, write_token_files
from factloom.session import scratch_path
from tests.compare import connect, differences
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    rows, wrong = differences(spark, connect(SMALL), SMALL, name)
    assert rows > 0 and not wrong


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


# --- quality rules


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n_lines


def test_statistics(odd, small_docs, rng):
    texts = [r.text for r in odd.collect()] + [r.text for r in small_docs.collect()]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(50)]
    got = np.array(outliers.block_statistics(pa.array([t or "" for t in texts]))).T
    assert [tuple(r) for r in got.tolist()] == [plain_statistics(t) for t in texts]


def test_outliers_are_rejected(spark, rng):
    """One language and source with a third of all rows, ordinary texts and a few of another kind."""
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 200))]
        if i % 40 == 0:
            words = [w * 4 + "||##" for w in words]
        rows.append((i, " ".join(words), "en", "hot" if i % 3 else f"s{i % 9}"))
    rows.append((600, "too short", "en", "hot"))
    out = {r.doc_id: r for r in judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(out) == 601 and out[600].base_failed and not out[600].kept
    assert {i for i, r in out.items() if not r.kept and not r.base_failed} == {i for i in range(600) if i % 40 == 0}


def test_concentration_lowers_the_determinant(spark):
    """On the rows of one group, the result is a fixed point of concentration: the nearest share has this fit."""
    r = np.random.default_rng(3)
    x = r.standard_normal((400, outliers.SIZE))
    x[:60] += 8
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "grp string, x array<double>")
    fit = outliers.minimum_covariance(rows, share=0.75, steps=8).first()
    centre, inverse = np.array(fit.centre), np.array(fit.inverse).reshape(outliers.SIZE, -1)
    d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    near = x[np.argsort(d)[:300]]
    assert np.allclose(near.mean(0), centre, atol=1e-9)
    assert (d[:60] > np.sort(d[60:])[-1]).all()


# --- lines


def plain_lines(rows, least=5, chars=40):
    docs = defaultdict(set)

    def key(line):
        return ascii_lower(line.strip(" \t\n\x0b\x0c\r"))

    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                docs[key(line)].add(doc_id)
    common = {k: max(d) for k, d in docs.items() if len(k) >= chars and len(d) >= least}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or common.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark, odd, rng):
    shared = [f"Shared line number {i} of forty or more CHARACTERS É" for i in range(6)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(100, 160):
        body = [rng.choice(shared + ["short", "", "  ", f"own line {i} " + "z" * 40]) for _ in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(b.upper() + " " if rng.random() < 0.3 else b for b in body)))
    rows += rows[-3:] + [(101, rows[-1][1])]
    got = drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=str)
    assert got == plain_lines(rows)
    assert sum(r[2] for r in got) > 0


# --- simhash


def plain_fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    groups = {f: {f} for f in set(prints)}
    for a in groups:
        for b in list(groups):
            if (a ^ b).bit_count() <= radius and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[b]:
                    groups[x] = groups[a]
    return {f: frozenset(g) for f, g in groups.items()}


def test_fingerprints(odd, small_docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(r.doc_id, r.text) for r in small_docs.collect()]
    got = simhash.shingle_fingerprints(pa.array([t or "" for _, t in rows]))
    assert got.tolist() == [plain_fingerprint(t) for _, t in rows]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 7])
def test_bit_sliced_distances(radius):
    r = np.random.default_rng(radius)
    left = r.integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64)
    right = left.copy()
    for i in range(5000):
        for b in r.integers(0, 64, r.integers(0, 9)):
            right[i] ^= np.uint64(1) << np.uint64(b)
    true = np.array([(int(a) ^ int(b)).bit_count() <= radius for a, b in zip(left, right, strict=True)])
    assert (simhash.within_radius(left, right, radius) == true).all()


@pytest.mark.parametrize(("bands", "tile"), [(None, 2048), (3, 4), (5, 3)])
def test_links_of_fingerprints(spark, rng, bands, tile):
    values = []
    for _ in range(60):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            values.append(value)
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
    values = sorted(set(values) | {0, 1, 2**64 - 1})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, bands, tile).collect()
    groups = {v: {v} for v in signed}
    for r in links:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 * len(values)
        if groups[r.a] is not groups[r.b]:
            groups[r.a] |= groups[r.b]
            for x in groups[r.b]:
                groups[x] = groups[r.a]
    back = {v: frozenset(x % 2**64 for x in groups[s]) for v, s in zip(values, signed, strict=True)}
    assert back == plain_components(values, 2)


def test_groups_of_documents(odd, small_docs):
    docs = odd.select("doc_id", "text", "key").unionByName(small_docs.selectExpr("doc_id + 100 as doc_id", "text", "'' as key"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    groups, lowest = plain_components(prints, 2), {}
    for (doc_id, _), f in zip(rows, prints, strict=True):
        if doc_id is not None:
            lowest[groups[f]] = min(doc_id, lowest.get(groups[f], doc_id))
    want = Counter((d, lowest.get(groups[f])) for (d, _), f in zip(rows, prints, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in simhash_groups(docs).collect()) == want


# --- language


def test_held_out_languages(small_docs):
    held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in small_docs.collect()]
    assert any(held)
    training = small_docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    model = learn_languages(training)
    found = {r.doc_id: r for r in identify_languages(small_docs, model).collect()}
    true = {r.doc_id: r.lang for r in small_docs.collect()}
    tested = [d for d, h in zip(true, held, strict=True) if h]
    assert sum(found[d].lang_pred == true[d] for d in tested) >= 0.95 * len(tested)


def test_mixed_text_is_cut_into_spans(spark, small_docs):
    model = learn_languages(small_docs)
    by_lang = {r.lang: r.text for r in small_docs.where("n_chars > 600").collect() if "!!" not in r.text and "|" not in r.text}
    parts = [" ".join(by_lang[v].split()[:60]) for v in ("en", "fr", "de")]
    out = identify_languages(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string"), model).first()
    assert [s.lang for s in out.spans] == ["en", "fr", "de"]
    assert all(abs(s.first_word - 60 * i) <= 4 for i, s in enumerate(out.spans))
    assert sum(s.n_words for s in out.spans) == 180


def test_paths_are_the_best(rng):
    """Texts walked together, texts walked alone, and all labellings of short texts agree."""
    from itertools import product

    import factloom.llm.language as language

    r = np.random.default_rng(5)
    lengths = np.array([0, 1, 5, 3, 6, 0, 2])
    scores = r.standard_normal((lengths.sum(), 3)) * 2
    together = label_spans(scores, lengths, 1.5)
    start = 0
    for n in lengths.tolist():
        own = scores[start : start + n]

        def value(path, own=own):
            return sum(own[i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        if n:
            best = max(product(range(3), repeat=n), key=value)
            assert abs(value(together[start : start + n].tolist()) - value(best)) < 1e-9
            assert abs(value(language._one_path(own, 1.5).tolist()) - value(best)) < 1e-9
        start += n


def test_other_scripts(spark):
    rows = [("the quick brown fox jumps over the lazy dog", "en"), ("быстрая коричневая лиса прыгает", "ru")] * 3
    model = learn_languages(spark.createDataFrame([(f"{t} {i}", v) for i, (t, v) in enumerate(rows)], "text string, lang string"))
    asked = [(1, "лиса"), (2, "fox"), (3, "123 !!"), (4, None), (5, "日本語")]
    out = {r.doc_id: r for r in identify_languages(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4)] == ["ru", "en", "und", "und"]
    assert out[4].score == 0 and out[5].lang_pred in ("en", "ru")


# --- token ids and pieces


def test_token_files(spark, odd, small_docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    assert tokenizer.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    docs = odd.select("doc_id", "text").unionByName(small_docs.selectExpr("doc_id + 100 as doc_id", "text"))
    extra = [(900, "a  b   c"), (901, "tabs\t and \n lines  \n x"), (902, " lead and trail "), (903, "  "), (904, "<|endoftext|> here"), (905, "hello <|endoftext|> world"), (906, "a<|endoftext|><|endoftext|>\n<|endoftext|"), (907, "one <|endof text|> two")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).repartition(3)
    out = str(tmp_path / "tokens")
    write_token_files(docs, BPE, out)
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_digests(read_token_files(spark, out)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    plan = read_token_files(spark, out, ("n_tokens",)).where("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids:array" not in plan


def test_words_are_encoded_together(odd):
    """Two blocks, of which the second has known and new words; few calls for a word, however many words there are."""
    encoder = WordEncoder(BPE)
    texts = [" ".join(f"word{i} again, number {i * 7}" for i in range(n, n + 400)) for n in (0, 200)]
    texts += [r.text or "" for r in odd.collect()]
    calls = Counter()
    for block in (texts, texts[1:] + ["unheard of things, 12345 of them"], [""], ["<|endoftext|>"]):
        sys.setprofile(lambda frame, event, arg: calls.update([event]))
        try:
            ids, sizes = encoder.encode_block(pa.array(block))
        finally:
            sys.setprofile(None)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in block]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert calls["call"] + calls["c_call"] < 5000, calls


def test_layout_of_token_files(spark, small_docs, tmp_path):
    out = tmp_path / "tokens"
    write_token_files(small_docs, BPE, str(out))
    file = pq.ParquetFile(next(out.glob("part-*.parquet")))
    group = file.metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_pieces_equal_the_library(small_docs, tmp_path):
    """The library's own best-score search over the same pieces and scores.

    It adds up single-precision scores, in which the file's score of -1e9 for runs of spaces drowns all
    others; with a score of ordinary size there, and texts of a few words, its sums are exact."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -60000.0)
    path = tmp_path / "pieces.model"
    path.write_bytes(proto.SerializeToString())
    library, model = sentencepiece.SentencePieceProcessor(model_file=str(path)), load_model(str(path))
    words = [w for r in small_docs.collect() for w in r.text.split(" ")]
    texts = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)] + [" a", "a  b", "   ", "x\ty", "日本語 😀 ﷽", "a" * 40]
    assert [t for t in texts if model.encode(t) != library.encode(t)] == []
    got = pieces.encode_block(model, {}, pa.array(texts))
    assert got[1].tolist() == [len(library.encode(t)) for t in texts]


def test_pieces_of_blocks_and_round_trip(odd, small_docs):
    docs = odd.select("doc_id", "text").unionByName(small_docs.selectExpr("doc_id + 100 as doc_id", "text"))
    model = load_model(PIECES)
    rows = docs.collect()
    encoded = encode_pieces(docs, PIECES, carry=("doc_id", "text"))
    for r in encoded.collect():
        assert r.ids == model.encode(r.text or "")
    back = Counter((r.doc_id, r.text) for r in decode_pieces(encoded.select("doc_id", "ids"), PIECES).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in rows)
    sums = Counter((r.doc_id, r.decoded_sha256) for r in piece_digests(encoded.select("doc_id", "ids"), PIECES).collect())
    assert sums == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)


def test_streaming_search_commits_early(rng):
    """Any score table: the windowed search finds the best total, and long runs are handed out in parts."""
    model = pieces.PieceModel.__new__(pieces.PieceModel)
    model.score = {p: (-rng.random() * len(p) ** 0.8, i) for i, p in enumerate(["a", "b", "aa", "ab", "aba", "bb", "aaaa", "bab"])}
    model.longest, model.unknown_score, model.byte_id, model.unknown_id = 4, -50.0, {}, 99
    model.trie = pieces.make_trie(model.score)
    for _ in range(60):
        text = "".join(rng.choice("aaab") for _ in range(rng.randint(1, 400)))
        parts = list(model.segments(text))
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            for n in range(1, min(4, end) + 1):
                if (s := model.score.get(text[end - n : end])) is not None:
                    best[end] = max(best[end], best[end - n] + s[0])
        by_id = {i: (p, s) for p, (s, i) in model.score.items()}
        ids = [i for part in parts for i in part]
        assert "".join(by_id[i][0] for i in ids) == text
        assert abs(sum(by_id[i][1] for i in ids) - best[-1]) < 1e-9
        assert len(text) < 100 or len(parts) > 1


# --- licences


def plain_scan(rows, threshold=0.75):
    from math import log, sqrt

    n = len(rows)
    vocabulary = {t for _, text in licenses.TEMPLATES for t in licenses.terms(text)}
    df = Counter(t for _, text in rows for t in vocabulary & set(licenses.terms(text or "")))
    unseen = log(1 + n) + 1
    idf = {t: log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}

    def vector(text):
        v = {t: c * idf.get(t, unseen) for t, c in Counter(licenses.terms(text)).items()}
        size = sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()}

    known = [(name, vector(text)) for name, text in licenses.TEMPLATES]
    own = []
    for _, text in rows:
        units = [vector(u) for u in [*(text or "").split("\n"), text or ""]]
        best = max(((round(sum(w * t.get(x, 0) for x, w in u.items()), 9), name) for u in units for name, t in known), key=lambda b: b[0])
        own.append(best[1] if best[0] >= threshold else None)
    held = defaultdict(set)
    for (path, _), lic in zip(rows, own, strict=True):
        if path and lic and re.search(licenses.LICENSE_FILE, path):
            held[path.rpartition("/")[0]].add(lic)
    out = []
    for (path, _), lic in zip(rows, own, strict=True):
        inherited, where = None, path.rpartition("/")[0] if path is not None else None
        while where is not None and inherited is None:
            if held.get(where):
                inherited = " AND ".join(sorted(held[where]))
            where = where.rpartition("/")[0] if where else None
        out.append((path, lic, inherited))
    return Counter(out)


def test_licenses(spark, small_docs):
    rows = [
        ("LICENSE", "Released under the MIT License."),
        ("src/a.py", "# Licensed under the Apache License, Version 2.0.\nimport os"),
        ("src/b.py", "import sys"),
        ("src/vendor/COPYING", "x\n" * 500 + "This work is licensed under the GNU General Public License, version 3."),
        ("src/vendor/LICENSE.txt", "Licensed under CC BY-NC 4.0"),
        ("src/vendor/deep/er/c.py", None),
        ("src/vendors/d.py", ""),
        ("src/b.py", "import sys"),
        (None, "Licensed under CC BY 4.0"),
    ]
    rows += [(f"docs/{r.source}/{r.doc_id}.txt", r.text) for r in small_docs.collect()]
    got = scan_licenses(spark.createDataFrame(rows, "path string, text string").repartition(4)).collect()
    assert Counter((r.path, r.own, r.inherited) for r in got) == plain_scan(rows)
    found = {r.path: r for r in got}
    assert found["src/vendor/deep/er/c.py"].license == "CC-BY-NC-4.0 AND GPL-3.0"
    assert found["src/a.py"].license == "Apache-2.0" and found["src/b.py"].license == "MIT"


# --- rows that every operator must take


def run_all(docs):
    model = learn_languages(docs)
    yield "statistics", judge_documents(docs)
    yield "lines", drop_common_lines(docs)
    yield "simhash", simhash_groups(docs)
    yield "language", identify_languages(docs, model)
    yield "licenses", scan_licenses(docs.withColumnRenamed("source", "path"))
    yield "pieces", piece_digests(encode_pieces(docs, PIECES), PIECES)
    out = scratch_path(docs.sparkSession, "odd")
    write_token_files(docs, BPE, out)
    yield "tokens", token_digests(read_token_files(docs.sparkSession, out))


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(request, table):
    docs = request.getfixturevalue(table)
    n = docs.count()
    for name, out in run_all(docs):
        assert out.count() == n, name


def test_blocks_give_memory_back():
    """What a step frees does not stay with the worker: a piece held at the end of the heap keeps the rest of it."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    blocks = text_blocks(iter([pa.RecordBatch.from_pydict({"text": ["a text"]})]))
    next(blocks)
    taken = [np.ones(1000) for _ in range(20_000)]
    held = taken[::1000]
    del taken
    before = resident()
    assert list(blocks) == []
    assert before - resident() > 80_000_000
    assert len(held) == 20
