"""SentencePiece ids of whole texts by a batched Viterbi search, and back."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_text, table, texts

SPACE = "\u2581"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_B = 0xD1B54A32D192ED03
#: Words longer than this are first cut where no piece has the two characters side by side.
_LONG = 24
#: Parts longer than this are searched one by one, with all their substrings probed at once.
_ALONE = 512


@dataclass
class PieceModel:
    """Arrays over the pieces of a model; ordinary pieces are sorted by hash."""

    keys: np.ndarray  # hashes, sorted
    ids: np.ndarray  # piece id of every key
    score: np.ndarray
    rank: np.ndarray  # order of merging, -1 for single characters
    left: np.ndarray  # row of the left and right half of the last merge
    right: np.ndarray
    length: np.ndarray
    power: np.ndarray  # powers of the multiplier
    longest: int
    merges: bool  # pieces come from merges, so neighbours must agree
    pairs: frozenset  # neighbouring characters inside pieces
    byte_ids: np.ndarray  # id for every byte, or the unknown id
    raw: np.ndarray  # bytes of all pieces by id, spaces as spaces
    raw_at: np.ndarray

    @staticmethod
    def load(path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        odd = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        own = [i for i in range(size) if not odd[i]]
        points = [np.frombuffer(pieces[i].encode("utf-32-le"), np.uint32) for i in own]
        hashed = np.array([_hash(p) for p in points], np.uint64)
        order = np.argsort(hashed)
        keys = hashed[order]
        if len(keys) > 1 and not (np.diff(keys) > 0).all():
            raise ValueError("two pieces have one hash")
        row = {pieces[own[j]]: r for r, j in enumerate(order.tolist())}
        names = [pieces[own[j]] for j in order.tolist()]
        score = np.array([sp.get_score(own[j]) for j in order.tolist()])
        # Scores of merged vocabularies count down from the first merge.
        merges = bool((np.diff(np.sort(-score[score > -1e8])) == 1).mean() > 0.9) if len(score) > 2 else False
        rank = np.where([len(n) > 1 for n in names], -score, -1.0)
        left = np.full(len(names), -1, np.int64)
        right = np.full(len(names), -1, np.int64)
        for r, name in enumerate(names if merges else []):
            halves = _last_merge(name, row, rank)
            if halves:
                left[r], right[r] = row[halves[0]], row[halves[1]]
            elif len(name) > 1:
                rank[r] = np.inf  # no merges lead to it
        longest = max(map(len, names))
        power = np.ones(2 * longest + 2, np.uint64)
        power[1:] = np.uint64(_B)
        np.multiply.accumulate(power, out=power)
        bytes_of = {pieces[i]: i for i in range(size) if sp.is_byte(i)}
        byte_ids = np.array([bytes_of.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)], "<u4")
        raw = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " \u2047 ".encode() if sp.is_unknown(i)
            else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        return PieceModel(
            keys, np.array(own, np.int64)[order], score, rank, left, right, np.array([len(n) for n in names]), power, longest,
            merges, frozenset(n[i : i + 2] for n in names for i in range(len(n) - 1)), byte_ids,
            np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in raw]))),
        )

    def __post_init__(self):
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._slot(self.keys)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Row of each hash among the sorted keys, -1 where there is none.

        A table of single bits turns most of the misses away before the search.
        """
        out = np.full(len(key), -1, np.int64)
        maybe = np.flatnonzero(self.filter[self._slot(key)])
        some = key[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[at] == some
        out[maybe[hit]] = at[hit]
        return out

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece a followed by piece b as they are.

        The last merges on both sides are undone, latest first; if the pieces
        then at the border form a piece that merges earlier than what was
        undone, merging would have joined them.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), np.inf)
        while len(at):
            whole = self.probe(self.keys[a] * self.power[self.length[b]] + self.keys[b])
            bad = (whole >= 0) & (self.rank[whole] < limit)
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 0.5)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of words of one length, all words advancing together.

        Returns the rows of pieces, word after word, -1 for a character without
        one, and where each word's rows end.
        """
        n, size = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * np.uint64(_B) + points[:, i] + np.uint64(1)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        piece = np.full((size + 1, n), -1, np.int64)  # the last piece of the best path to here
        back = np.ones((size + 1, n), np.int64)
        unknown = float(self.score[self.score > -1e8].min()) - 10
        for end in range(1, size + 1):
            alone = self.probe(prefix[end] - prefix[end - 1] * self.power[1]) < 0
            best[end, alone] = best[end - 1, alone] + unknown
            for span in range(1, min(self.longest, end) + 1):
                start = end - span
                row = self.probe(prefix[end] - prefix[start] * self.power[span])
                at = np.flatnonzero((row >= 0) & np.isfinite(best[start]))
                if not len(at):
                    continue
                row, before = row[at], piece[start][at]
                if self.merges:
                    ok = np.isfinite(self.rank[row])
                    if start:
                        both = ok & (before >= 0)
                        ok[both] = self.agree(before[both], row[both])
                    at, row = at[ok], row[ok]
                value = best[start][at] + self.score[row]
                up = value > best[end][at]
                at, row = at[up], row[up]
                best[end][at], piece[end][at], back[end][at] = value[up], row, span
        steps = np.zeros((size, n), np.int64) - 2
        here = np.full(n, size)
        every, k = np.arange(n), 0
        while (here > 0).any():
            live = here > 0
            steps[k, live] = piece[here[live], every[live]]
            here = here - np.where(live, back[here, every], 0)
            k += 1
        path = steps[:k][::-1].T
        return path[path > -2], np.cumsum((path > -2).sum(axis=1))


    def viterbi_alone(self, word: str) -> np.ndarray:
        """Rows of the best pieces of one long word, -1 for a character without one.

        The substrings of one length are hashed and probed together; only those
        that are pieces take part in the search, which goes on character by
        character. Time and memory grow with the word's length.
        """
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(points)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # (length, row) of the pieces that end here
        key = np.zeros(n, np.uint64)
        for span in range(1, min(self.longest, n) + 1):
            key = key[: n - span + 1] * np.uint64(_B) + points[span - 1 :] + np.uint64(1)
            row = self.probe(key)
            for at in np.flatnonzero(row >= 0).tolist():
                found[at + span].append((span, int(row[at])))
        unknown = float(self.score[self.score > -1e8].min()) - 10
        best, piece, back = [0.0] + [-np.inf] * n, [-1] * (n + 1), [1] * (n + 1)
        score, rank = self.score.tolist(), self.rank.tolist()
        together: dict[tuple[int, int], bool] = {}
        for end in range(1, n + 1):
            if not found[end] or found[end][0][0] > 1:
                best[end] = best[end - 1] + unknown
            for span, row in found[end]:
                start = end - span
                value = best[start] + score[row]
                if value <= best[end] or best[start] == -np.inf:
                    continue
                if self.merges:
                    if rank[row] == np.inf:
                        continue
                    if start and piece[start] >= 0:
                        both = (piece[start], row)
                        if both not in together:
                            together[both] = bool(self.agree(np.array([both[0]]), np.array([row]))[0])
                        if not together[both]:
                            continue
                best[end], piece[end], back[end] = value, row, span
        out, at = [], n
        while at > 0:
            out.append(piece[at])
            at -= back[at]
        return np.array(out[::-1], np.int64)


def _hash(points: np.ndarray) -> int:
    h = 0
    for p in points.tolist():
        h = (h * _B + p + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _last_merge(name: str, row: dict[str, int], rank: np.ndarray) -> tuple[str, str] | None:
    parts, last = list(name), None
    while len(parts) > 1:
        found = [(rank[row[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in row]
        if not found:
            return None
        i = min(found)[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = ["".join(last)]
    return last


class Encoder:
    """Ids of texts; distinct words of a slice are searched once and remembered.

    The memory of words is emptied when it holds more than cache_bytes.
    """

    def __init__(self, model: PieceModel, cache_bytes: int = 64_000_000):
        self.model, self.most = model, cache_bytes
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        if "  " in text or text.endswith(" ") or SPACE in text:
            return _WORD.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + w for w in text.split(" ")]

    def _cut(self, word: str) -> list[str]:
        pairs, out, last = self.model.pairs, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                out.append(word[last:i])
                last = i
        return [*out, word[last:]]

    def learn(self, words: Iterable[str]) -> None:
        cache, model = self.cache, self.model
        whole, parts = {}, set()
        for w in words:
            if len(w) > _LONG:
                whole[w] = self._cut(w)
                parts.update(p for p in whole[w] if p not in cache)
            else:
                parts.add(w)
        by_size: dict[int, list[str]] = {}
        for p in parts:
            by_size.setdefault(len(p), []).append(p)
        for size, group in by_size.items():
            if size > _ALONE:
                for p in group:
                    rows = model.viterbi_alone(p)
                    cache[p] = self._with_bytes(p, rows)
                    self.held += len(cache[p]) + 200 + 2 * size
                continue
            step = max(1, 200_000 // size)
            for lo in range(0, len(group), step):
                some = group[lo : lo + step]
                rows, ends = model.viterbi(some)
                raw = model.ids[rows].astype("<u4").tobytes()
                odd = np.add.reduceat(rows < 0, np.concatenate(([0], ends[:-1]))).tolist()
                last = 0
                self.held += len(raw) + len(some) * (200 + 2 * size)  # of strings and of the table, about
                for p, end, unknown in zip(some, ends.tolist(), odd):
                    cache[p] = self._with_bytes(p, rows[last:end]) if unknown else raw[4 * last : 4 * end]
                    last = end
        for w, cut in whole.items():
            cache[w] = b"".join([cache[p] for p in cut])
            self.held += len(cache[w]) + 200 + 2 * len(w)

    def _with_bytes(self, word: str, rows: np.ndarray) -> bytes:
        out, at, model = [], 0, self.model
        for r in rows.tolist():
            if r >= 0:
                out.append(model.ids[r : r + 1].astype("<u4").tobytes())
                at += int(model.length[r])
            else:
                out.append(model.byte_ids[list(word[at].encode())].tobytes())
                at += 1
        return b"".join(out)

    def encode(self, many: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        split = [self.words(t) if t else [] for t in many]
        if self.held > self.most:
            self.cache, self.held = {}, 0
        cache = self.cache
        self.learn({w for words in split for w in words if w not in cache})
        return [b"".join([cache[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that encoding puts first."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return ""
        start, size = self.model.raw_at[i], self.model.raw_at[i + 1] - self.model.raw_at[i]
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))
        text = self.model.raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


FIELDS = [
    T.StructField("ids", T.BinaryType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("decoded", T.StringType()),
    T.StructField("round_trip", T.BooleanType()),
]


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> Encoder:
    """The encoder of a model file, kept by a worker process for all tasks it runs, with its bounded memory of words."""
    return Encoder(PieceModel.load(path))


def encode_documents(docs: DataFrame, model_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids (little-endian unsigned 32-bit), their count, the decoded text and whether it equals the text.

    The model's pieces are read from the file; the search is ours. For
    vocabularies of scored pieces it is plain Viterbi. For vocabularies of merges
    the same search admits a piece only after a piece that merging would leave
    beside it, which gives the ids that merging gives. Null and empty texts have
    no ids and decode to ''. A text that holds the space mark U+2581 itself comes
    back with spaces. Equal texts give equal rows; an empty table gives none;
    columns other than keep are dropped, kept ones named as ours are replaced.
    """
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def start():
        encoder = _loaded(path)

        def work(column: pa.Array) -> dict[str, pa.Array]:
            source = texts(column)
            ids = encoder.encode(source)
            decoded = [encoder.decode(i) for i in ids]
            return {
                "ids": pa.array(ids, pa.binary()),
                "n_ids": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "decoded": pa.array(decoded, pa.string()),
                "round_trip": pa.array([a == b for a, b in zip(source, decoded)], pa.bool_()),
            }

        return work

    return map_text(docs, start, FIELDS, keep)


def op10_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"), "round_trip"
    )
