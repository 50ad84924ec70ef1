"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

Text becomes symbols; an agenda (heap) offers the adjacent pair whose joined piece has the best
score, leftmost on ties; a joined pair offers its new neighbours. No merge-type vocabulary piece here
has a word mark after another character, and none has a character such as a line feed at all, so a
text falls into segments that no merge crosses. Segments recur, so each worker keeps those of up to
LONG characters, CACHE_CHARS characters of them at most, and longer ones for one batch alone. In each Arrow batch, every segment that is new to the worker is also encoded by the
sentencepiece library, and a difference ends the job. Decoding is the library's decode(ids).

Defined results: null text is encoded as empty text, which has the end id alone; decoded text is what
the library gives; texts are taken whole; an input column named like an output column gives way.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_docs, without

MARK = "▁"
#: Characters of segments that a worker remembers before it starts anew (about 250 MB), and the longest one that it keeps.
CACHE_CHARS, LONG = 6_000_000, 200
#: Segments of up to SHORT characters are merged in step, ROWS at a time.
SHORT, ROWS = 32, 4096
_NEVER = float("inf")
#: Texts that normalisers other than the identity would change.
_ODD = ["a  b", " a ", "\t\u00a0x\u3000", "\uff21\ufb01\u2167\u00bd", "e\u0301 \u1100\u1161", "\u200b\ufeff\u0000x\r\n"]


class PieceCodec:
    """Encoder for one merge-type model file with an identity normaliser, as the library configures it."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.rank = {p: -self.lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark after another character; segments would not be independent")
        self.lone = {c for c in ("\n", "\t", "\r") if c not in joined}
        lone = "".join(map(re.escape, sorted(self.lone)))
        self.cutter = re.compile(rf"[{lone}]|{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" if lone else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}
        self.alone = self.lib.encode("\n")[:1]  # the dummy prefix by itself
        self.chars, self.long = 0, []
        self.names = list(map(str, range(n)))
        self._table()
        for said in _ODD:
            if self.lib.normalize(said) != MARK + said.replace(" ", MARK):
                raise ValueError(f"the model's normaliser changes {said!r}; only the dummy prefix and marks for spaces are expected")

    def _table(self) -> None:
        """Symbols by number (pieces, then characters that only occur in pieces), and what each adjacent pair joins to."""
        pieces = list(self.ids)
        symbols = pieces + sorted({c for p in pieces for c in p} - set(pieces))
        number = {s: k for k, s in enumerate(symbols)}
        self.n_pieces, self.id_of = len(pieces), np.array([self.ids[p] for p in pieces])
        lone = sorted((ord(s), k) for s, k in number.items() if len(s) == 1)
        self.points, self.point_symbols = np.array(lone, np.int64).T
        pairs = sorted((number[p[:k]] << 32 | number[p[k:]], self.rank[p], number[p]) for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pairs = np.array([p[0] for p in pairs])
        self.pair_ranks, self.pair_symbols = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of each pair of symbols; the rank is _NEVER where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (b >= 0), self.pair_ranks[at], _NEVER), self.pair_symbols[at]

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment. Short ones are merged in step, a row each: the row's agenda holds its pairs, its best one is joined."""
        out: list = [None] * len(segments)
        order = sorted((k for k, s in enumerate(segments) if len(s) <= SHORT), key=lambda k: len(segments[k]))
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            for k, ids in zip(some, self._in_step([segments[k] for k in some]), strict=True):
                out[k] = ids
        return [self.merge(s) if ids is None else ids for s, ids in zip(segments, out, strict=True)]

    def _in_step(self, segments: list[str]) -> list[list[int] | None]:
        """As merge_all; None for a segment with a symbol that is no piece."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        n, width = len(segments), int(sizes.max()) + 1
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        # A row for each segment, with one place of no symbol at its end; places are numbered through all rows.
        symbols = np.full((n, width), -1, np.int64)
        here = np.arange(width) < sizes[:, None]
        symbols[here] = np.where(self.points[at] == points, self.point_symbols[at], -2)
        rank, joined = np.full((n, width), _NEVER), np.zeros((n, width), np.int64)
        rank[:, :-1], joined[:, :-1] = self._looked_up(symbols[:, :-1], symbols[:, 1:])
        symbols, joined, here, flat = symbols.ravel(), joined.ravel(), here.ravel(), rank.ravel()
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        row = np.arange(n)
        while len(row):
            best = rank[row].argmin(1) if len(row) < n else rank.argmin(1)  # the leftmost
            i = row * width + best
            live = flat[i] < _NEVER
            row, i = row[live], i[live]
            j = after[i]
            k = after[j]
            symbols[i], here[j], flat[j] = joined[i], False, _NEVER
            after[i], before[k] = k, i
            flat[i], joined[i] = self._looked_up(symbols[i], symbols[k])
            h = before[i[i % width > 0]]
            flat[h], joined[h] = self._looked_up(symbols[h], symbols[after[h]])
        ids = np.where((symbols >= 0) & (symbols < self.n_pieces), self.id_of[np.clip(symbols, 0, self.n_pieces - 1)], -1)
        ends = np.concatenate([[0], np.cumsum(here.reshape(n, width).sum(1))]).tolist()
        ids = ids[here].tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905
        return [None if -1 in x else x for x in out] if -1 in ids else out

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the agenda as a heap."""
        ids = [(self.ids.get(s), s) for s in self._merged(segment)]
        return [x for i, s in ids for x in ([i] if i is not None else [self.bytes[b] for b in s.encode()])]

    def _merged(self, segment: str) -> list[str]:
        rank, symbols = self.rank, list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                continue  # one of the two has gone into another merge
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if longer in rank:
                    heapq.heappush(agenda, (rank[longer], i, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if longer in rank:
                    heapq.heappush(agenda, (rank[longer], h, longer))
        return [s for s in symbols if s is not None]

    def segments(self, text: str) -> list[str]:
        return self.cutter.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Segments of each text; those not yet known are encoded, and checked against the library."""
        cut = [self.segments(t) for t in texts]
        for s in self.long:
            self.cache.pop(s, None)
        if self.chars > CACHE_CHARS:
            self.cache.clear()
            self.chars = 0
        new = list({s for c in cut for s in c}.difference(self.cache))
        made = self.merge_all(new)
        # A line feed first, where a segment has no mark: the dummy prefix then stands before that, not before the segment.
        said = self.lib.encode([s[1:] if s[0] == MARK else "\n" + s for s in new], num_threads=1)
        theirs = [x if s[0] == MARK else x[2:] for s, x in zip(new, said, strict=True)]
        if MARK in new:
            theirs[new.index(MARK)] = self.alone
        if made != theirs:
            raise ValueError(f"agenda and library differ: {next(x for x in zip(new, made, theirs, strict=True) if x[1] != x[2])}")
        name = self.names.__getitem__
        self.cache.update((s, (tuple(ids), " ".join(map(name, ids)))) for s, ids in zip(new, made, strict=True))
        self.long = [s for s in new if len(s) > LONG]
        self.chars += sum(map(len, new)) - sum(map(len, self.long))
        return cut

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the end id."""
        (cut,) = self.learn([text])
        return [i for s in cut for i in self.cache[s][0]] + [self.lib.eos_id()]


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """Adds n_tokens (long), ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded (string)."""
    docs = without(docs, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")

    def run(texts):
        c = codec(path)
        eos = c.lib.eos_id()
        out = [[], [], []] + ([[], []] if ids else [])
        for at in range(0, len(texts), 64):
            part = [t or "" for t in texts[at : at + 64]]
            coded, said = [], []
            for segments in c.learn(part):
                known = [c.cache[s] for s in segments]
                coded.append([i for mine, _ in known for i in mine] + [eos])
                said.append(" ".join([s for _, s in known] + [str(eos)]))
            decoded = c.lib.decode(coded, num_threads=1)
            out[0] += map(len, coded)
            out[1] += (hashlib.sha256(s.encode()).hexdigest() for s in said)
            out[2] += (hashlib.sha256(s.encode()).hexdigest() for s in decoded)
            if ids:
                out[3] += coded
                out[4] += decoded
        return out

    return map_docs(docs, run, [text_col], "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids, [c for c in docs.columns if ids or c != text_col])


def query(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path or public_tokenizers.path("piece_bpe_32k.model"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
