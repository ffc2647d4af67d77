"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from factloom.llm.blocks import carried, coded, distinct_codes, joined_runs, list_array, split_lists, text_blocks

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNKNOWN_PENALTY = 10.0
#: Kinds of a piece in a model file (fixed values of the public format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KNOWN_LIMIT = 300_000
BLOCK = 6_000_000


def make_trie(score: dict[str, tuple[float, int]]) -> dict:
    """character -> [following characters, score, id]; id -1 where no piece ends."""
    root: dict = {}
    for piece, (value, ident) in score.items():
        level = root
        for c in piece[:-1]:
            level = level.setdefault(c, [{}, 0.0, -1])[0]
        last = level.setdefault(piece[-1], [{}, 0.0, -1])
        last[1], last[2] = value, ident
    return root


class PieceModel:
    """Pieces and scores of a model file; a segmentation's score is the sum of its pieces' scores."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normalizer = proto.normalizer_spec
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("only models without text normalization can be decoded to the same text")
        self.prefix = SPACE if normalizer.add_dummy_prefix else ""
        self.score = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown_id = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_score = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.score))
        self.trie = make_trie(self.score)
        self.bytes_of = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
            else p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b""
            for p in proto.pieces
        ]
        #: No piece goes on from another character to a space mark: paths always meet before a word.
        self.words_apart = all(SPACE not in piece.lstrip(SPACE) for piece in self.score)

    def segments(self, text: str) -> Iterator[list[int]]:
        """Ids of the best segmentation of ``text`` (spaces already marked), handed out as they are certain.

        best[b] = (score, previous boundary, id or -1 for an unknown character) for the boundaries of a
        window; boundaries beyond ``reach`` have no path yet, so ``at`` to ``reach`` are the surviving
        ends, at most a longest piece apart. Once their back pointers converge on one boundary, the ids
        before it are committed and the window starts there anew.
        """
        trie, longest, unknown = self.trie, self.longest, self.unknown_score
        base, size = 0, len(text)
        best: list[tuple[float, int, int] | None] = [(0.0, 0, -1)] + [None] * min(size, longest)
        at, reach, look = 0, 0, 4 * longest
        while base + at < size:
            here = best[at]
            if here is not None:
                if at >= look:
                    meet = self._meeting(best, at, reach)
                    look = at + 4 * longest
                    if meet:
                        yield self._ids(best, meet, text[base : base + meet])
                        base, at, reach, look = base + meet, at - meet, reach - meet, 4 * longest
                        best = [b and (b[0], b[1] - meet, b[2]) for b in best[meet:]]
                total, level, to, single = best[at][0], trie, at, False
                if len(best) <= at + longest:
                    best.extend([None] * (4 * longest))
                for c in text[base + at : base + at + longest]:
                    node = level.get(c)
                    if node is None:
                        break
                    to += 1
                    level, score, ident = node
                    if ident >= 0:
                        if to == at + 1:
                            single = True
                        old = best[to]
                        if old is None or total + score > old[0]:
                            best[to] = (total + score, at, ident)
                            if to > reach:
                                reach = to
                if not single and (best[at + 1] is None or total + unknown > best[at + 1][0]):
                    best[at + 1] = (total + unknown, at, -1)
                    if at + 1 > reach:
                        reach = at + 1
            at += 1
        if at:
            yield self._ids(best, at, text[base:])

    @staticmethod
    def _meeting(best: list, at: int, reach: int) -> int:
        """The last boundary that the back pointers of all surviving ends pass."""
        ends = {b for b in range(at, reach + 1) if best[b] is not None}
        while len(ends) > 1:
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(best[furthest][1])
        return ends.pop()

    def _ids(self, best: list, end: int, text: str) -> list[int]:
        """Follow the back pointers; unknown characters become bytes, or one unknown piece."""
        out: list[int] = []
        while end:
            _, start, ident = best[end]
            if ident >= 0:
                out.append(ident)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(text[start:end].encode()))
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
            end = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        marked = self.prefix + text.replace(" ", SPACE) if text else ""
        return [i for part in self.segments(marked) for i in part]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:] if self.prefix and raw[:1] == b" " else raw


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


#: Ids of words seen before, at most KNOWN_LIMIT for each model, kept by a worker between blocks.
_known: dict[str, dict[str, np.ndarray]] = {}


def encode_block(model: PieceModel, known: dict[str, np.ndarray], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and how many each text has.

    Where no piece spans the start of a word, all paths meet there, so the search may start anew at
    every space after another character; then each distinct word of the block is searched once. Texts
    with several spaces in a row are cut before the first of each run."""

    def searched(word: str, keep: bool) -> np.ndarray:
        ids = known.get(word)
        if ids is None:
            ids = np.array([i for part in model.segments(word) for i in part], np.int32)
            if keep and len(known) < KNOWN_LIMIT:
                known[word] = ids
        return ids

    if model.words_apart:
        odd = pc.match_substring_regex(texts, r"^ |  | $|^$").to_numpy(zero_copy_only=False)
    else:
        odd = np.ones(len(texts), bool)
    whole = {}
    for i in np.flatnonzero(odd).tolist():
        text = texts[i].as_py()
        marked = model.prefix + text.replace(" ", SPACE) if text else ""
        cut = _WORD.findall(marked) if model.words_apart else [marked]
        whole[i] = np.concatenate([np.zeros(0, np.int32), *[searched(w, False) for w in cut]])

    flat, row = split_lists(pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " "))
    codes, distinct = coded(flat)
    marked = np.ones(len(row), bool)
    if not model.prefix:
        marked[1:], marked[:1] = row[1:] == row[:-1], False
    values, keys, seen = distinct_codes(codes * 2 + marked, 2 * len(distinct))
    strings = distinct.to_pylist()
    parts = [searched((SPACE if v & 1 else "") + strings[v >> 1], n > 1) for v, n in zip(values.tolist(), seen.tolist(), strict=True)]
    plain = ~odd[row]
    return joined_runs(parts, keys[plain], row[plain], whole, len(texts))


def encode_pieces(docs: DataFrame, model_path: str, carry: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK) -> DataFrame:
    """The columns ``carry`` with ids (array<int>) for every row of ``docs``, which has text.

    Ids are those of the best-scoring segmentation under the scores of the model file at
    ``model_path``, which every worker can read; ties go to the segmentation found first. A null or
    empty text has no ids. Characters without a piece become byte pieces. Any text can be decoded to
    itself. Rows stay where they are; nothing is shuffled. Other columns are ignored. Texts are worked on
    in blocks of about ``block_bytes``: smaller ones take less memory, larger ones find more words again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        known = _known.setdefault(model_path, {})
        for block in text_blocks(batches, limit=block_bytes):
            ids, sizes = encode_block(model, known, block.column("__text"))
            arrays = [*[block.column(c) for c in carry], list_array(ids, sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, "ids"])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, f"{carried(docs, carry)}, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give a null text; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                texts = [
                    None if ids is None else model.decode_bytes(ids).decode("utf-8", "replace")
                    for ids in part.column("ids").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_bytes, decoded_sha256) from (doc_id, ids), with the ids decoded again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            rows = []
            for ids in batch.column("ids"):
                values = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                text = model.decode_bytes(values.tolist())
                rows.append((len(values), zlib.crc32(values.astype("<u4").tobytes()), len(text), hashlib.sha256(text).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "n_ids", "ids_crc32", "decoded_bytes", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_bytes long, decoded_sha256 string"
    return encoded.mapInArrow(run, schema)
