"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a segment the table holds the one token that ends the
prefix's encoding.  Candidates are the vocabulary entries that an automaton
finds ending there; a candidate stands if its start is the segment's start or
if it is compatible with the token that ends the prefix before it, i.e. if
merging the two tokens' joined characters gives back just these two.  Ids are
recovered by walking the table backwards.  Work is linear in a segment's length
whatever that is, so one very long word costs no more a byte than short ones.

No piece has a space mark behind another character, none holds a line end beside
another character, and none holds a character that is no piece itself (all asserted
when the model is loaded), so text is cut before runs of space marks and at line
ends, and each distinct short segment is encoded about once per worker (a memo of two
bounded generations).

Text is never normalised but for the leading space mark, as the model says.
Null text counts as empty; empty text has no ids.  Repeated rows and ids get a row
each, and rows have no order.  An empty table gives an empty result.  Extra columns
pass through; a column of the name of an added one is replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagram.llm.common import buffers, pieces

MARK = "▁"
#: Entries of a generation of the segment memo and of the pair memo; a full generation becomes the old one, whose entries come back when they are met.
MEMO, PAIRS = 150_000, 300_000
SEGMENT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder of one byte-fallback BPE model."""

    def __init__(self, model_bytes: bytes):
        import ahocorasick
        import sentencepiece.sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(model_bytes)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models that add a leading space and change nothing else are handled")
        self.text: list[str] = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        for piece in self.id_of:
            if MARK in piece.lstrip(MARK) or (len(piece) > 1 and ("\n" in piece or any(c not in self.id_of for c in piece))):
                raise ValueError(f"segments can't be cut for a model with the piece {piece!r}")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unk = next(i for i, k in enumerate(kinds) if k == 2)
        self.raw = [
            bytes([int(s[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else s.replace(MARK, " ").encode()
            for s, k in zip(self.text, kinds, strict=True)
        ]
        self.found = ahocorasick.Automaton()
        # (piece, better than which it may not be merged) at the right and at the left edge, from whole to first character
        self.right: dict[str, list[tuple[str, float]]] = {}
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.ordered = True
        for piece, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            if len(parts := self._merge(piece, 2)) <= 2 and (len(parts) == 1 or self.score.get(piece) is not None):
                self.found.add_word(piece, (i, len(piece)))
                own = self.score[piece] if len(piece) > 1 else float("inf")  # characters are there from the start
                self.right[piece], self.left[piece] = [(piece, own)], [(piece, own)]
                if len(parts) == 2:
                    a, b = parts
                    self.ordered &= piece[-1] == MARK or (self.right[a][0][1] > own and self.right[b][0][1] > own)
                    self.right[piece] += self.right[b]
                    self.left[piece] += self.left[a]
        self.found.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old_memo: dict[str, tuple[int, ...]] = {}

    def _merge(self, s: str, least: int = 1) -> list[str]:
        """The pieces of a short string by the definition: again and again the best adjacent pair, the leftmost of equals, down to ``least`` parts."""
        parts, score = list(s), self.score
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merges_across(self, a: str, b: str) -> bool:
        """Whether merging a's and b's characters together would join two parts across their border.

        Pieces are made in the order of their scores, so going back in time the
        later made of the two parts at the border comes apart.  A pair of parts
        joins if its score beats those of the merges that ended the two parts;
        of equal scores the left merge comes first.
        """
        score, right, left = self.score, self.right[a], self.left[b]
        i = j = 0
        end_x = end_y = -float("inf")
        while True:
            x, made_x = right[i]
            y, made_y = left[j]
            r = score.get(x + y)
            if r is not None and r > end_x and r >= end_y:
                return True
            single_x, single_y = i + 1 == len(right), j + 1 == len(left)
            if single_x and single_y:
                return False
            if single_y or (not single_x and made_x < made_y):
                end_x, i = made_x, i + 1
            else:
                end_y, j = made_y, j + 1

    def _compatible(self, left: int, right: int) -> bool:
        """The same as a test of two tokens, for pairs that aren't in the memo."""
        key = left << 32 | right
        known = self.old_pairs.get(key)
        if known is None:
            a, b = self.text[left], self.text[right]
            known = not self.merges_across(a, b) if self.ordered and a[-1] != MARK else self._merge(a + b) == [a, b]  # runs of marks all have one score
        if len(self.pairs) >= PAIRS:
            self.old_pairs, self.pairs = self.pairs, {}
        self.pairs[key] = known
        return known

    def segment(self, s: str) -> tuple[int, ...]:
        last: list[tuple[int, int] | None] = [None] * len(s)
        known, test = self.pairs.get, self._compatible
        for end, token in self.found.iter(s):
            if last[end] is None:
                before = end - token[1]
                if before < 0:
                    last[end] = token
                    continue
                left = last[before]
                if left is not None:
                    fits = known(left[0] << 32 | token[0])
                    if fits is None:
                        fits = test(left[0], token[0])
                        known = self.pairs.get  # a generation may have ended
                    if not fits:
                        continue
                last[end] = token
        out, i = [], len(s) - 1
        while i >= 0:
            token = last[i]
            if token is None:
                raw = s[i].encode()
                out.extend([self.byte[b] for b in reversed(raw)] if self.byte else [self.unk])
                i -= 1
            else:
                out.append(token[0])
                i -= token[1]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.memo.get
        for s in SEGMENT.findall(MARK + text.replace(" ", MARK)):
            got = known(s)
            if got is None:
                got = self.old_memo.get(s)
                if got is None:
                    got = self.segment(s)
                if len(s) <= 48:
                    if len(self.memo) >= MEMO:
                        self.old_memo, self.memo = self.memo, {}
                        known = self.memo.get
                    self.memo[s] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        joined = b"".join(map(self.raw.__getitem__, ids))
        if ids and self.text[ids[0]].startswith(MARK):
            joined = joined[1:]
        return joined.decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def _model_bytes(spark: SparkSession, model_path: str | None) -> bytes:
    """The model file's content, read once on the driver; a fixed vocabulary file of about half a MB."""
    with open(model_path or default_model(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int), the whole text's ids without begin or end."""
    return encode_decode(docs, text_col, ids_col, None, model_path)


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """Adds the text of ``ids``; null ids count as none."""
    model = _model_bytes(docs.sparkSession, model_path)
    keep = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            text = pa.array([codec.decode([i for i in x if i is not None] if x else []) for x in ids.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, out_col])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField(out_col, T.StringType())]))


def encode_decode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", out_col: str | None = "decoded", model_path: str | None = None) -> DataFrame:
    """Adds ``ids`` and, decoded from those ids, ``decoded``, in one pass over the rows."""
    model = _model_bytes(docs.sparkSession, model_path)
    keep = docs.drop(*[c for c in (ids_col, out_col) if c])
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]
    if out_col:
        added.append(T.StructField(out_col, T.StringType()))
    raw_col = "__utf8"
    src = keep.withColumn(raw_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            at = whole.schema.get_field_index(raw_col)
            _, offsets = buffers(whole.column(at))
            for lo, hi in pieces(offsets, 1 << 20):
                b = whole.slice(lo, hi - lo)
                flat, ends, texts = [], [0], []
                for raw in b.column(at):
                    ids = codec.encode(raw.as_py().decode("utf-8", "replace"))
                    flat += ids
                    ends.append(len(flat))
                    if out_col:
                        texts.append(codec.decode(ids))
                cols = [b.column(i) for i in range(b.num_columns) if i != at]
                names = [n for n in b.schema.names if n != raw_col]
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                names.append(ids_col)
                if out_col:
                    cols.append(pa.array(texts, pa.string()))
                    names.append(out_col)
                yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, T.StructType([*keep.schema.fields, *added]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = encode_decode(docs, model_path=model_path)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
