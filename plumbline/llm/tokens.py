"""Token counts by Viterbi over a unigram vocabulary, without making the tokens.

A text is cut before each space as by a Metaspace pre-tokenizer (spaces become
U+2581, which is put first where it is missing). In each unit an Aho-Corasick
automaton lists all vocabulary pieces by their end; dynamic programming carries,
for each end, the best score and the number of pieces of the segmentation that
has it. Ties go as in the unigram model of the ``tokenizers`` library: of equal
scores at one end, the piece that starts first stays. A character that is no
piece costs the lowest score less 10, and counts as its bytes where the
vocabulary has byte pieces, else a run of such counts one.

The distinct units of some texts are found first and counted together: the automaton is a
table over bytes, and one step of it and of the dynamic programming is taken for thousands
of units at once. Units that have characters beyond ASCII of no piece, or are very long, are
counted alone, with the same result.

Defined results: null and empty texts have 0 tokens; a null id stays null; every
row gets a count, repeated rows the same; other columns are ignored. A unit may be
as long as the text: work is proportional to its matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .textops import buffers, text_chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_UNITS, CACHE_CHARS = 400_000, 64
#: Units that are counted together, and the bytes up to which a unit is; longer ones are counted alone, with the same result.
UNITS, UNIT_BYTES = 1 << 14, 64
#: Bytes of text whose units are found together.
CHUNK = 4 << 20
COUNTS = "doc_id long, n_tokens long"
_MARK, _UNKNOWN_COST = "▁", 10.0


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class Counter(dict):
    """Pieces of a unit; computed when it is first asked for."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.matches = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                best[piece] = score
        for piece, score in best.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.scores, self.together = best, None
        self.single = frozenset(p for p in best if len(p) == 1)
        self.unknown = min(s for _, s in pieces) - _UNKNOWN_COST
        self.bytes = all(f"<0x{b:02X}>" in best for b in range(256))

    def __missing__(self, unit: str) -> int:
        n = self.count(unit)
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = n
        return n

    def count(self, unit: str) -> int:
        """Pieces of the best segmentation of U+2581 and the unit."""
        unit = _MARK + unit
        if not self.single.issuperset(unit):
            return self._with_unknown(unit)
        n = len(unit) + 1
        best, pieces = [float("-inf")] * n, [0] * n
        best[0] = 0.0
        for end, (size, score) in self.matches.iter(unit):
            end += 1
            score += best[end - size]
            if score > best[end]:
                best[end] = score
                pieces[end] = pieces[end - size] + 1
        return pieces[-1]

    def _with_unknown(self, unit: str) -> int:
        n = len(unit) + 1
        best, pieces, run = [float("-inf")] * n, [0] * n, [False] * n
        best[0] = 0.0
        missing = [c not in self.single for c in unit]
        done = 0

        def settle(upto: int, done: int) -> int:
            while done < upto:  # the piece of one character comes last at its end
                if missing[done] and best[done] + self.unknown > best[done + 1]:
                    best[done + 1] = best[done] + self.unknown
                    own = len(unit[done].encode("utf-8", "surrogatepass")) if self.bytes else 0 if run[done] else 1
                    pieces[done + 1], run[done + 1] = pieces[done] + own, True
                done += 1
            return done

        for end, (size, score) in self.matches.iter(unit):
            done = settle(end, done)
            end += 1
            score += best[end - size]
            if score > best[end]:
                best[end], pieces[end], run[end] = score, pieces[end - size] + 1, False
        settle(n - 1, done)
        return pieces[-1]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        units = (text.replace(_MARK, " ") if _MARK in text else text).split(" ")
        if not units[0] and len(units) > 1:
            units = units[1:]
        return sum(map(self.__getitem__, units))

    def texts(self, column: pa.Array) -> np.ndarray:
        """What ``text`` gives for each; the distinct units of all texts are counted together."""
        column = column.cast(pa.large_string()).fill_null("")
        column = pc.replace_substring(column, _MARK, " ")
        spaced, nothing = (x.to_numpy(zero_copy_only=False) for x in (pc.starts_with(column, " "), pc.equal(column, "")))
        units = pc.split_pattern(column, " ")
        ends = np.cumsum(pc.list_value_length(units).to_numpy())
        each = units.flatten().dictionary_encode()
        distinct, at = each.dictionary, each.indices.to_numpy()
        del column, units, each  # else they are held beside the tables of counting
        pa.default_memory_pool().release_unused()
        pieces = self.units(distinct)
        sums = np.concatenate([[0], np.cumsum(pieces[at])])
        out = np.diff(sums[np.concatenate([[0], ends])])
        out[spaced] -= self.count("")  # no unit before the first space
        out[nothing] = 0
        return out

    def units(self, column: pa.Array) -> np.ndarray:
        """What ``count`` gives for each unit."""
        if self.together is None:
            self.together = Together(self.scores, self.unknown)
        raw, offsets = buffers(pc.binary_join_element_wise(pa.scalar(_MARK, pa.large_string()), column.cast(pa.large_string()), pa.scalar("", pa.large_string())))
        n = np.diff(offsets)
        odd = raw >= 0x80 if self.bytes else (raw >= 0x80) | self.together.missing[raw]
        wide = np.add.reduceat(odd, offsets[:-1], dtype=np.int64) > len(_MARK.encode()) if len(n) else n > 0
        alone = np.flatnonzero(wide | (n > UNIT_BYTES)) if _MARK in self.single else np.arange(len(n))
        texts = column.take(pa.array(alone)).to_pylist()
        done = {i: self.count(u) for i, u in zip(alone.tolist(), texts, strict=True) if n[i] > UNIT_BYTES or not self.single.issuperset(_MARK + u)}
        out = np.zeros(len(n), np.int64)
        rest = np.ones(len(n), bool)
        rest[list(done)] = False
        rest = np.flatnonzero(rest)
        rest = rest[np.argsort(-n[rest], kind="stable")]
        for k in range(0, len(rest), UNITS):
            of = rest[k : k + UNITS]
            out[of] = self.together.counts(raw, offsets[of], n[of])
        out[list(done)] = list(done.values())
        return out


class Together:
    """The automaton as tables over bytes, walked for many units at once.

    ``step`` leads from a state by a byte; ``piece`` names the longest piece that ends
    in a state (as the state that spells it, 0 for none) and ``shorter`` the next one.
    """

    def __init__(self, scores: dict[str, float], unknown: float):
        self.unknown = unknown
        self.missing = np.array([b < 0x80 and chr(b) not in scores for b in range(256)])
        below: list[dict[int, int]] = [{}]
        spelt: dict[int, tuple[int, float]] = {}
        for text, score in scores.items():
            at, data = 0, text.encode("utf-8", "surrogatepass")
            for b in data:
                if b not in below[at]:
                    below[at][b] = len(below)
                    below.append({})
                at = below[at][b]
            spelt[at] = (len(data), score)
        k = len(below)
        kind = np.min_scalar_type(k)  # of the smallest kind, as each worker holds the table
        self.step = np.zeros((k, 256), kind)
        self.size, self.score = np.zeros(k, np.int64), np.zeros(k)
        for at, (size, score) in spelt.items():
            self.size[at], self.score[at] = size, score
        self.piece, self.shorter, back = np.zeros(k, kind), np.zeros(k, kind), np.zeros(k, kind)
        level = [0]
        while level:
            further = []
            for at in level:
                own = back[at]
                self.shorter[at] = self.piece[own] if at else 0
                self.piece[at] = at if at in spelt else self.shorter[at]
                row = self.step[own].copy() if at else np.zeros(256, kind)
                for b, to in below[at].items():
                    back[to] = row[b]
                    row[b] = to
                    further.append(to)
                self.step[at] = row
            level = further

    def counts(self, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Pieces of the best segmentation of each unit; the longest unit comes first, and each can be segmented."""
        best, pieces = np.full((int(n[0]) + 1, len(n)), -np.inf), np.zeros((int(n[0]) + 1, len(n)), np.int32)
        best[0] = 0.0
        state = np.zeros(len(n), self.step.dtype)
        live = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0])), side="right")
        for at in range(int(n[0])):
            k = int(live[at])
            state = self.step[state[:k], raw[start[:k] + at]]
            ends = self.piece[state]
            rows = np.flatnonzero(ends)
            ends = ends[rows]
            top, many = best[at + 1], pieces[at + 1]
            while len(rows):
                begin = at + 1 - self.size[ends]
                score = best[begin, rows] + self.score[ends]
                more = score > top[rows]
                hit = rows[more]
                top[hit] = score[more]
                many[hit] = pieces[begin[more], hit] + 1
                ends = self.shorter[ends]
                left = ends > 0
                rows, ends = rows[left], ends[left]
            rows = np.flatnonzero(self.missing[raw[start[:k] + at]])
            if len(rows):  # a byte of no piece comes last at its end
                score = best[at, rows] + self.unknown
                rows, score = rows[score > top[rows]], score[score > top[rows]]
                top[rows], many[rows] = score, pieces[at, rows] + 1
        return pieces[n, np.arange(len(n))]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker and vocabulary."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in text_chunks(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(of.texts(batch.column("text")), pa.int64())], ["doc_id", "n_tokens"])

    need = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, COUNTS)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
