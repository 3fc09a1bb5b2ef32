"""SentencePiece BPE encoding and decoding by a table of last tokens.

Merge-type BPE has a local property: a token sequence is the encoding of its text exactly if each pair of
neighbours is the encoding of its own text, and of all tokens that end at a position, just one follows
the encoding of the prefix before it. So an Aho-Corasick automaton over the vocabulary walks the text
once; at each position the match whose pair with the last token of the prefix before it is compatible is
stored; ids are recovered from the end backwards. A pair is tested along the two tokens' merge trees: the
symbols on either side of the border grow in order of score, and the pair fails if a piece across the
border would come first (leftmost on ties, as in the library). Where scores tie or a piece scores better
than its parts, the two tokens' text is merged outright. Results are remembered.

Pieces hold the space mark only as a prefix, so a text falls into chunks that start at a run of marks;
chunks repeat, and each task process remembers the last ones, twice CACHE at most. Characters that no piece holds become byte
tokens. Decoding is piece by piece from the ids: bytes join to UTF-8, marks become spaces, the one that
encoding put before the text goes.

Edge cases: a null or empty text is the end id alone and decodes to nothing; a text of any length is
encoded whole; rows are independent, so ties and repeated rows give equal results; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE, LONG = 150_000, 48


#: What an unknown id decodes to, and the handling of broken bytes: a replacement character for each.
UNKNOWN, EACH = " \u2047 ", "overlook-each-byte"
codecs.register_error(EACH, lambda e: ("\ufffd", e.start + 1))


class Codec:
    def __init__(self, model_file: str | None = None):
        import ahocorasick
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file or public_tokenizers.path(MODEL))
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.byte = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.silent = {i for i in range(len(sp)) if sp.is_control(i) or sp.is_unknown(i)}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.byte and i not in self.silent}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        counts = Counter(self.score.values())
        self.tied = {s for s, n in counts.items() if n > 1}
        self.trees: dict[int, tuple[list, list] | None] = {}
        letters = {c for p in self.ids for c in p}
        if len(self.byte) != 256 or not letters <= set(self.ids) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model isn't of the kind whose texts fall apart at space marks, with bytes for unknown characters")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [p]:  # a piece that merging can't reach never occurs
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        #: Chunks met lately, and those met before them: a full memory ages instead of being forgotten.
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.plain = [None if i in self.byte else "" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.names = [str(i) for i in range(len(self.pieces))]
        blank = "".join(c for c in "\n\t\r\x0b\x0c" if c not in letters)
        self.chunks = re.compile(f"{MARK}+[^{MARK}{blank}]*|[^{MARK}{blank}]+|[{blank}]+" if blank else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def merged(self, text: str, last: list[str] | None = None) -> list[str]:
        """The merges themselves, for one or two pieces' text: the pair of best score, leftmost on ties, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            if last is not None:
                last[:] = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, token: int) -> tuple[list, list] | None:
        """A token's symbols at its left and its right border from the letter up, each with its score; None where scores don't fall on the way up."""
        found = self.trees.get(token, 0)
        if found == 0:
            piece = self.pieces[token]
            parts = [piece] if len(piece) == 1 else self.halves(piece)
            found = ([], []) if len(parts) == 1 else tuple(self.spines(self.ids[p]) for p in parts)
            if len(parts) == 2:
                s = self.score[piece]
                sure = None not in found and s not in self.tied and all(len(p) == 1 or self.score[p] > s for p in parts)
                found = (found[0][0] + [(s, piece)], found[1][1] + [(s, piece)]) if sure else None
            else:
                found = ([(0.0, piece)], [(0.0, piece)])
            self.trees[token] = found
        return found

    def halves(self, piece: str) -> list[str]:
        """The two parts of a piece's last merge."""
        last: list[str] = []
        self.merged(piece, last)
        return last

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            left, right = self.spines(a), self.spines(b)
            if left is None or right is None:
                x, y = self.pieces[a], self.pieces[b]
                found = self.merged(x + y) == [x, y]
            else:
                found = self._apart(left[1], right[0])
            self.pairs[key] = found
        return found

    def _apart(self, left: list, right: list) -> bool:
        """Whether no piece across the border forms while both sides grow."""
        i = j = 0
        score = self.score.get
        while True:
            cross = score(left[i][1] + right[j][1])
            up = left[i + 1][0] if i + 1 < len(left) else None
            down = right[j + 1][0] if j + 1 < len(right) else None
            if cross is not None and (up is None or cross > up) and (down is None or cross >= down):
                return False
            if up is None and down is None:
                return True
            if down is None or up is not None and up >= down:
                i += 1
            else:
                j += 1

    def encode_chunk(self, chunk: str) -> list[int]:
        n = len(chunk)
        last = [-1] * n  # by last character; -1: a character that no piece holds (and, at -1, the start: a match never reaches back to it unless it is one)
        last.append(-1)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(chunk):
            if last[end] < 0:
                before = last[end - length]
                if before >= 0:
                    fits = pairs.get(before << 20 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
                last[end] = token
        out: list[int] = []
        pieces = self.pieces
        while n:
            token = last[n - 1]
            if token < 0:
                out += [self.byte_id[b] for b in reversed(chunk[n - 1].encode())]
                n -= 1
            else:
                out.append(token)
                n -= len(pieces[token])
        out.reverse()
        return out

    def text_of(self, ids: list[int]) -> str:
        """ids decoded, space marks as spaces, nothing stripped."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            out.append(self.plain[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text) of a chunk."""
        found = self.known.get(chunk) or self.older.get(chunk)
        if found is None:
            ids = self.encode_chunk(chunk)
            texts = [self.plain[i] for i in ids]
            found = len(ids), " ".join([self.names[i] for i in ids]), self.text_of(ids) if None in texts else "".join(texts)
        if len(chunk) <= LONG:
            if len(self.known) >= CACHE:
                self.older, self.known = self.known, {}
            self.known[chunk] = found
        return found

    def both(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text) of a text, end id included."""
        if not text:
            return 1, str(self.end), ""
        known = self.known.get
        parts = [known(c) or self.chunk(c) for c in self.chunks.findall(MARK + text.replace(" ", MARK))]
        counts, ids, texts = zip(*parts)
        return sum(counts) + 1, f"{' '.join(ids)} {self.end}", "".join(texts)[1:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.both(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Any ids: control ids are silent, the first piece after them loses its space mark, an unknown id and each byte that ends up in no character have signs of their own."""
        lead = next((k for k, i in enumerate(ids) if i not in self.silent or i == self.unknown), len(ids))
        out: list[str] = []
        for k, run in groupby(ids[lead:], lambda i: "b" if i in self.byte else "u" if i == self.unknown else "t"):
            run = list(run)
            out.append(bytes(self.byte[i] for i in run).decode(errors=EACH) if k == "b" else UNKNOWN * len(run) if k == "u" else "".join(self.plain[i] for i in run))
        text = "".join(out)
        return text[1:] if lead < len(ids) and self.pieces[ids[lead]].startswith(MARK) else text


_CODECS: dict[str | None, Codec] = {}


def codec(model_file: str | None = None) -> Codec:
    """One codec for each task process."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def _digests(model_file: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(model_file).both
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column("text").to_pylist():
                n, i, t = both(text or "")
                counts.append(n)
                ids.append(hashlib.sha256(i.encode()).hexdigest())
                texts.append(hashlib.sha256(t.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digests(model_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _column(f, name: str, kind: pa.DataType, model_file: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f(c, x) for x in batch.column("x").to_pylist()], kind)], names=["doc_id", name])

    return run


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, end id included."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("x"))
    return rows.mapInArrow(_column(lambda c, x: c.encode(x), "ids", pa.list_(pa.int32()), model_file), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids decode to an empty text."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("x"))
    return rows.mapInArrow(_column(lambda c, x: c.decode(x or []), "text", pa.string(), model_file), "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
