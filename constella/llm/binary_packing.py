"""Packing by power-of-two decomposition: no sequence crosses documents.

A document's ids and the closing id are cut, from the front, into whole
sequences of ``longest`` ids and then into one piece per binary digit of the
rest, longest first. Every piece is a sequence of its own whose length is a
power of two, so nothing is padded; sequences of equal length form a bucket and
are stored together, so that a batch of one bucket has one shape.

A text is split into the pre-tokens of the vocabulary's byte-level pattern;
merges never cross them, so each distinct pre-token goes through the
``tokenizers`` library's merges once and its ids are remembered, as are those of
what stands between two spaces (two generations of about ``REMEMBER`` strings a
worker).

Pieces are dealt evenly over the partitions by a running number, whatever
document or copy they come from, sorted by length and written under
``length=...``. ``sequence_id`` holds the bucket (from bit 58), the partition
(from bit 33) and the place in it, so numbers are unique without a count over
all rows.

Ids are stored as little-endian unsigned numbers of ``width`` bytes: 2 where the
vocabulary allows it, else 4.

Defined cases: null and empty texts give one sequence with the closing id
alone; documents and ids may repeat or be null, each row is packed by itself;
texts of any length are packed whole; strings of special tokens are ordinary
text; extra columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm.common import share

REMEMBER = 400_000
#: rows go on in groups of about this many bytes of text
GROUP_BYTES = 4_000_000


class Known(dict):
    """Ids of strings, made once. Full, it becomes the generation that the next
    one takes its frequent strings from."""

    def __init__(self, make, older=None):
        self.make, self.older = make, older or {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids

    def renewed(self):
        if len(self) < REMEMBER:
            return self
        self.older = {}
        return Known(self.make, self)


def _letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable ones for themselves, the others for 256, 257, ..."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + i for i, b in enumerate(others)}


LETTERS = _letters()
LETTERS_SPACE = chr(LETTERS[32])
#: letters that every version of the character tables agrees on
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch

#: signs that are a pre-token of their own between a letter and a space
CLOSING = frozenset(".,;:!?")


def _letters_of(word: str) -> str:
    """The letters of a pre-token's bytes; printable ASCII but the space
    stands for itself."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", LETTERS_SPACE)
    return word.encode().decode("latin-1").translate(LETTERS)


def _plain(text: str) -> bool:
    """No white space beside a space and no space at an end. Other white space
    than spaces and new lines is never looked at closely."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
                or not text.replace("\n", "").isprintable())


class Tokens:
    """Ids of texts as little-endian numbers of ``width`` bytes."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, encoding="utf-8") as f:
            self.packed = f.read()
        self.pattern, self.known = pattern, None  # tables are made in the worker
        self.width = 2 if max(self._tokenizer().get_vocab().values()) < 1 << 16 else 4

    def _tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.packed)

    def _open(self):
        import regex

        tokenize, kind = self._tokenizer().model.tokenize, "H" if self.width == 2 else "I"
        self.split = regex.compile(self.pattern).findall

        def merged(word):
            return array(kind, [t.id for t in tokenize(_letters_of(word))]).tobytes()

        self.known = Known(merged)
        self.after_space = Known(self._after_space)

    def _after_space(self, part: str) -> bytes:
        if LATIN(part):  # a space and Latin letters are one pre-token
            return self.known.make(" " + part)
        if part[-1:] in CLOSING and LATIN(part[:-1]):  # so is the sign behind them, where the part ends
            return self.after_space[part[:-1]] + self.known[part[-1]]
        return self.whole(" " + part)

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.known is None:
            self._open()
        self.known, self.after_space = self.known.renewed(), self.after_space.renewed()
        plain = [_plain(t) for t in texts]
        ids = iter(self._plain_texts([t for t, p in zip(texts, plain) if p]))
        return [next(ids) if p else self.whole(t) for t, p in zip(texts, plain)]

    def _plain_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts. A space between two other signs always begins a
        pre-token, so a text is its parts between spaces; each distinct part
        of the texts is looked up once."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        ids = list(map(self.after_space.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        part = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        part[np.cumsum(count) - count] = np.arange(len(ids), len(ids) + len(texts))  # no space before the first
        ids += [self.whole(t.split(" ", 1)[0]) for t in texts]
        n = np.array([len(x) // self.width for x in ids])
        body, start = np.frombuffer(b"".join(ids), f"<u{self.width}"), np.cumsum(n) - n
        n, start = n[part], start[part]
        ends = np.cumsum(n)
        body = body[np.arange(ends[-1]) + np.repeat(start - (ends - n), n)].tobytes()
        ends = (ends[np.cumsum(count) - 1] * self.width).tolist()
        return [body[lo:hi] for lo, hi in zip([0, *ends], ends)]


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    whole = n // longest
    out = [(k * longest, longest) for k in range(whole)]
    at = whole * longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if n & (1 << bit):
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pieces(docs: DataFrame, vocabulary: str, pattern: str, longest: int = 2048, closing: int = 1) -> DataFrame:
    """doc_id, start, length, ids (binary), ids_crc32 (of unsigned 32-bit
    ids), doc_tokens and spread, a running number that differs from piece to
    piece. ``longest`` is a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    tokens = Tokens(vocabulary, pattern)
    width = tokens.width
    shared = share(docs.sparkSession, tokens)
    kind = dict(docs.dtypes)["doc_id"]

    def rows(ids, texts, encode, count):
        at, start, length, body, crc, total = [], [], [], [], [], []
        end = closing.to_bytes(width, "little")
        for k, packed in enumerate(encode(texts)):
            packed += end
            wide = np.frombuffer(packed, f"<u{width}").astype("<u4").tobytes()
            n = len(packed) // width
            for s, size in cuts(n, longest):
                at.append(k)
                start.append(s)
                length.append(size)
                body.append(packed[width * s:width * (s + size)])
                crc.append(zlib.crc32(wide[4 * s:4 * (s + size)]))
                total.append(n)
        return pa.RecordBatch.from_pydict({
            "doc_id": ids.take(pa.array(at, pa.int64())), "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()), "ids": pa.array(body, pa.binary()),
            "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
            "spread": pa.array(np.arange(count, count + len(at)), pa.int64())})

    def run(batches):
        encode = shared()
        context = TaskContext.get()
        count = (context.partitionId() if context else 0) << 36
        for batch in batches:
            begin, size, texts = 0, 0, []
            for row, text in enumerate(batch.column("text")):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= GROUP_BYTES or row + 1 == batch.num_rows:
                    out = rows(batch.column("doc_id").slice(begin, len(texts)), texts, encode, count)
                    count += out.num_rows
                    yield out
                    begin, size, texts = row + 1, 0, []

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, spread long")


def pack(docs: DataFrame, path: str, vocabulary: str, pattern: str, longest: int = 2048, closing: int = 1) -> None:
    """Writes all sequences to ``path``, one folder per length: doc_id, start,
    ids, ids_crc32, doc_tokens, sequence_id, offset (0: a sequence is one
    piece) and the partition column length."""
    dealt = (pieces(docs, vocabulary, pattern, longest, closing).repartition("spread")
             .sortWithinPartitions("length").drop("spread"))
    bucket = F.length(F.bin("length")) - 1
    number = F.shiftleft(bucket.cast("long"), 58) + F.monotonically_increasing_id()
    (dealt.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})
     .write.partitionBy("length").parquet(path))


def read_packed(spark: SparkSession, path: str, id_kind: str = "long") -> DataFrame:
    """The sequences that ``pack`` wrote."""
    return spark.read.schema(f"doc_id {id_kind}, start long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, "
                             "offset long, length long").parquet(path)
