"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton holds every ordinary piece. One pass over the text follows its output links: at each place it yields all pieces
that end there, longest first, and each relaxes the best score of that place from the place where it begins. A character that
no piece covers costs UNKNOWN below the least score and becomes its UTF-8 bytes' pieces. Of equal scores the longer last piece
stays. Where no piece has a space after another character (checked on the vocabulary), no piece crosses the start of a run of
spaces, so the best path of a text is that of its runs joined, and runs seen before are looked up.

The scores of a unigram model are log-probabilities and are used as they stand. Those of a BPE model are its merges' ranks, whose
sums mean nothing: a piece of rank r gets ln(1 / ((r + 1) H)) instead, its probability under Zipf's law, H being the sum of
1 / r. Nothing is trained. The ids are those of the likeliest path under these scores, not the ids of a BPE encoder, which
applies merges in turn; both decode to the text.

The vocabulary is read once on the driver and sent to the tasks: its size is the model file's.

Nulls and odd input: a null text has null ids, an empty one none; a text may hold the space mark U+2581 itself or any other
character: decoding gives the text back; null ids decode to null; control ids and ids out of range decode to nothing; columns of
the input are kept, but one named like the output is replaced; repeated rows stay rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm._common import WORD, with_arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, UNKNOWN, CACHE = "▁", 10.0, 250_000
RUN = re.compile(r" *[^ ]*")


class _Cache(dict):
    """Results of work for texts seen lately, 2 * CACHE at most; long ones are not kept.

    A full cache becomes the older half, out of which what is used again returns.
    """

    def __init__(self, work: Callable[[str], bytes]) -> None:
        self.work, self.older = work, {}

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            out = self.work(text)
        if len(text) <= 32:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out


@dataclass
class Codec:
    pieces: list[tuple[str, float, str]]  # (piece, score, kind)
    automaton: ahocorasick.Automaton | None = None

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) or model.is_unused(i) else "normal"
        pieces = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]
        normal = sorted((i for i, (_, _, k) in enumerate(pieces) if k == "normal"), key=lambda i: -pieces[i][1])
        if all(pieces[i][1].is_integer() for i in normal):  # ranks of merges
            total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
            for r, i in enumerate(normal):
                pieces[i] = (pieces[i][0], -math.log(r + 1) - total, "normal")
        return cls(pieces)

    def built(self) -> Codec:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            normal = [(p, s, i) for i, (p, s, k) in enumerate(self.pieces) if k == "normal"]
            for p, s, i in normal:
                self.automaton.add_word(p, (len(p), s, i))
            self.automaton.make_automaton()
            self.singles = {p for p, _, _ in normal if len(p) == 1}
            self.fallback = min(s for _, s, _ in normal) - UNKNOWN
            self.by_byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == "byte"}
            self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == "unknown"), 0)
            self.splits = not any(SPACE in p.lstrip(SPACE) for p, _, _ in normal)
            self.runs = _Cache(self._ids)
            self.words = _Cache(lambda word: self._ids(f" {word}"))
        return self

    def viterbi(self, text: str) -> list[int]:
        """Ids of a text whose spaces are real spaces."""
        # The mark itself may stand in the text: no piece has a NUL, so there it falls back to bytes.
        s = text.replace(SPACE, "\0").replace(" ", SPACE)
        n = len(s)
        best, back = [0.0] + [float("-inf")] * n, [(1, self.fallback, -1)] * (n + 1)
        covered, done = self.singles.issuperset(s), 0
        for end, found in self.automaton.iter(s):
            if not covered:  # places between that no piece ends at
                self._unknown(best, back, s, done, end + 1)
                done = end + 1
            to = end + 1
            x = best[to - found[0]] + found[1]
            if x > best[to]:
                best[to], back[to] = x, found
        if not covered:
            self._unknown(best, back, s, done, n)
        out, at = [], n
        while at:
            size, _, i = back[at]
            at -= size
            if i >= 0:
                out.append(i)
            else:
                out += reversed([self.by_byte.get(b, self.unknown) for b in text[at].encode("utf-8", "surrogatepass")])
        return out[::-1]

    def _unknown(self, best: list[float], back: list[tuple[int, float, int]], s: str, start: int, end: int) -> None:
        """Characters from start to end that are no piece."""
        for at in range(start, end):
            if s[at] not in self.singles and best[at] + self.fallback > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + self.fallback, (1, self.fallback, -1)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers in the machine's order."""
        if not text:
            return b""
        if not self.splits:
            return self._ids(f" {text}")
        if text[0] == " " or "  " in text:
            return b"".join(map(self.runs.__getitem__, RUN.findall(f" {text}")))
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def _ids(self, run: str) -> bytes:
        return np.array(self.viterbi(run), np.int32).tobytes()

    def surfaces(self) -> list[bytes]:
        """Bytes of each id."""
        return [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else b"" for p, _, k in self.pieces]


def _decoded(ids: list[int | None], surfaces: list[bytes]) -> str:
    return _decoded_all(pa.array([ids], pa.list_(pa.int32())), surfaces)[0].as_py()


def _decoded_all(lists: pa.ListArray, surfaces: list[bytes]) -> pa.Array:
    values, ends = lists.values.fill_null(-1).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    known = np.where((values >= 0) & (values < len(surfaces)), values, len(surfaces))
    parts = list(map([*surfaces, b""].__getitem__, known.tolist()))
    texts = [b"".join(parts[a:b]).decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends, ends[1:], strict=False)]
    return pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())


def _mapped(df: DataFrame, col: str, out: str, kind: str, codec: Codec, work) -> DataFrame:  # noqa: ANN001
    shared = df.sparkSession.sparkContext.broadcast(codec.pieces)

    def started():  # noqa: ANN202
        do = work(Codec(shared.value))
        return lambda column: [do(column)]

    return with_arrow(df, col, started, StructType.fromDDL(f"{out} {kind}"))


def encoded(df: DataFrame, text_col: str = "text", out: str = "ids", path: str = MODEL) -> DataFrame:
    """df with the ids of each whole text."""

    def work(codec: Codec):  # noqa: ANN202
        codec.built()

        def do(texts: pa.Array) -> pa.Array:
            values, ends, missing = [], [0], []
            for t in texts.to_pylist():
                values.append(codec.packed(t or ""))
                ends.append(ends[-1] + len(values[-1]) // 4)
                missing.append(t is None)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), np.int32)), mask=pa.array(missing))

        return do

    return _mapped(df, text_col, out, "array<int>", Codec.load(path), work)


def decoded(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """df with the text of each list of ids."""

    def work(codec: Codec):  # noqa: ANN202
        surfaces = codec.surfaces()
        return lambda lists: _decoded_all(lists, surfaces)

    return _mapped(df, ids_col, out, "string", Codec.load(path), work)


def tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """The result of op10: ids of each whole text, ids a word (null without words), and whether they decode to the text."""
    both = decoded(encoded(docs.select("doc_id", "text"), path=path), path=path)
    n = F.coalesce(F.size("ids"), F.lit(0))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return both.select("doc_id", n.cast("long").alias("n_tokens"), F.round(F.try_divide(n, words), 6).alias("tokens_per_word"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
