"""BPE encoding and decoding with word ends, by tree concatenation for long text.

A token sequence is the encoding of a string exactly when every two
neighbouring tokens are the encoding of their own text. So the encodings of two
halves can be joined: re-encode a window of k tokens on either side of the cut,
growing k until the window's outermost tokens come out as they were; every pair
of neighbours has then been seen to be right.

Texts of at least ``LONG_CHARS`` characters are cut into parts (at white space
where there is some, else inside the run), the parts are dealt over the cluster
and encoded in parallel, and each text's parts are joined in a binary tree.
Shorter texts are encoded where they are read, without a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmart.llm.common import keyed

LONG_CHARS = 1 << 16
PART_CHARS = 1 << 14
#: White space of the vocabulary's own patterns; unlike str.split() it leaves U+001C to U+001F alone.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
#: PRETOKEN for words of printable ASCII.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
#: How so many ids are written.
IDS = [struct.Struct(f"<{n}I").pack for n in range(33)]
SPACE = re.compile(f"[{BLANK}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.cache
def newer() -> re.Pattern:
    """A character that Unicode 3.2 did not have, or whose lower case it did not have. All others keep
    their normal form, lower case and class in every later version, so Python's tables serve for them."""
    old = unicodedata.ucd_3_2_0.category
    runs: list[list[int]] = []
    for c in range(128, 0x110000):
        if old(chr(c)) == "Cn" or any(old(x) == "Cn" for x in chr(c).lower()):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs) + "]")


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Token bytes by word; two generations bound the memory, so common words stay."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class _Symbols(dict):
    """Printable characters of the UTF-8 bytes by character: at most all of Unicode."""

    def __init__(self):
        super().__init__()
        self.bytes = byte_chars()

    def __missing__(self, char: str) -> str:
        self[char] = found = "".join(map(self.bytes.__getitem__, char.encode()))
        return found


class WordBpe:
    """One vocabulary file: exact ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, cache: int = 200_000, piece: int = 2048):
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        self.path, self.piece = path, piece
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.suffix = self.model.end_of_word_suffix or ""
        self.symbols = _Symbols()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = _Words(self._word, cache)
        self.tokens = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self._bare = None
        self.settled: set[str] = set()  # characters seen that are not newer: at most all of Unicode

    # text -> words
    def sections(self, text: str) -> Iterator[tuple[int | None, str]]:
        """Control strings of the vocabulary and the normalised text between them; words with a
        ``newer`` character are left as they are, for ``pretokens``."""
        for i, part in enumerate(self.cut.split(text) if "<|" in text else [text]):
            if i % 2:
                yield self.special[part], part
            elif part:
                yield None, part.lower() if part.isascii() else self.lowered(part)

    @staticmethod
    def split(text: str) -> list[str]:
        if SEPARATORS.search(text):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def encode(self, text: str) -> bytes:
        get = self.words.__getitem__
        return b"".join([struct.pack("<I", special) if special is not None else b"".join(map(get, self.split(part)))
                         for special, part in self.sections(text)])

    def _word(self, word: str) -> bytes:
        if len(word) <= 64 and word.isascii() and word.isprintable():
            # its symbols are its characters, and each of its pretokens is a word of its own
            if word.isalpha():
                return self.ids_of(word)
            pres = PLAIN.findall(word)
            return b"".join(map(self.words.__getitem__, pres)) if len(pres) > 1 else self.ids_of(word)
        return b"".join([self.ids_of(symbols) for symbols in self.pretokens(word)])

    def ids_of(self, symbols: str) -> bytes:
        out = self.tree(symbols) if len(symbols) > self.piece else [t.id for t in self.model.tokenize(symbols)]
        return IDS[len(out)](*out) if len(out) < len(IDS) else struct.pack(f"<{len(out)}I", *out)

    def lowered(self, part: str) -> str:
        # most texts hold nothing but characters that earlier ones held
        if not (unknown := set(part) - self.settled):
            return normal(part)
        new = newer().search
        if not any([new(c) or self.settled.add(c) for c in unknown]):
            return normal(part)
        # normal form and lower case depend on nothing beyond a word
        return " ".join([w if new(w) else normal(w) for w in self.split(part)])

    def pretokens(self, word: str) -> list[str]:
        """Runs of byte symbols that merges never cross. For newer characters the file's own normaliser
        and pre-tokenizer decide, as letters and lower case differ between versions of Unicode."""
        if not word.isascii() and not self.settled.issuperset(word) and newer().search(word):
            return [pre for pre, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(word))]
        return ["".join(map(self.symbols.__getitem__, pre)) for pre in PRETOKEN.findall(word)]

    # one unsplit run of symbols
    def run(self, symbols: str, final: bool = True) -> list[int]:
        """Ids of a run; ``final`` if it ends a word (its last symbol then carries the word end)."""
        model = self.model if final else self.bare
        return [t.id for t in model.tokenize(symbols)]

    @property
    def bare(self):
        """The same merges without a word end, for the inner parts of a run."""
        if self._bare is None:
            from tokenizers.models import BPE
            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self._bare = BPE(model["vocab"], merges)
        return self._bare

    def tree(self, symbols: str) -> list[int]:
        """Encode halves, then join them."""
        cuts = range(0, len(symbols), self.piece)
        return self.join_all([self.run(symbols[c:c + self.piece], c + self.piece >= len(symbols)) for c in cuts])

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join the parts of one run pairwise; only the last part ends the word."""
        while len(parts) > 1:
            n = len(parts)
            parts = [self.join(parts[i], parts[i + 1], i + 2 >= n) if i + 1 < n else parts[i] for i in range(0, n, 2)]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int], final: bool) -> list[int]:
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            ends = final and k >= len(right)
            text = "".join(self.tokens[i] for i in a + b)
            if ends and self.suffix:
                text = text[:-len(self.suffix)]
            window = self.run(text, ends)
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return left[:-k] + window + right[k:]
            k *= 2

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False): this vocabulary has no
        decoder, so the tokens are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    # parts of a long text
    def parts(self, text: str, size: int = PART_CHARS) -> Iterator[tuple[int, int, str]]:
        """(run, kind, text): kind 0 whole words, 1 inner part of an unsplit run (symbols),
        2 its last part, 3 a control string. Parts of one run share the run number."""
        run = 0
        for special, part in self.sections(text):
            if special is not None:
                run += 1
                yield run, 3, part
                continue
            held, n = [], 0
            for word in self.split(part):
                if len(word) > size:
                    if held:
                        run += 1
                        yield run, 0, " ".join(held)
                        held, n = [], 0
                    for symbols in self.pretokens(word):
                        run += 1
                        for c in range(0, len(symbols), size):
                            yield run, 2 if c + size >= len(symbols) else 1, symbols[c:c + size]
                    continue
                held.append(word)
                n += len(word) + 1
                if n >= size:
                    run += 1
                    yield run, 0, " ".join(held)
                    held, n = [], 0
            if held:
                run += 1
                yield run, 0, " ".join(held)

    def part_ids(self, kind: int, text: str) -> bytes:
        if kind == 0:
            return b"".join(map(self.words.__getitem__, self.split(text)))
        if kind == 3:
            return struct.pack("<I", self.special[text])
        ids = self.join_all([self.run(text[c:c + self.piece], kind == 2 and c + self.piece >= len(text))
                             for c in range(0, len(text), self.piece)]) if kind == 2 else self.inner(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def inner(self, symbols: str) -> list[int]:
        parts = [self.run(symbols[c:c + self.piece], False) for c in range(0, len(symbols), self.piece)]
        while len(parts) > 1:
            n = len(parts)
            parts = [self.join(parts[i], parts[i + 1], False) if i + 1 < n else parts[i] for i in range(0, n, 2)]
        return parts[0]

    def joined(self, parts: list[tuple[int, int, bytes]]) -> bytes:
        """Ids of a text from (run, kind, ids) of its parts in order."""
        out, open_run = [], []
        for _, kind, ids in parts:
            if kind in (1, 2):
                open_run.append(np.frombuffer(ids, "<u4").tolist())
                if kind == 2:
                    whole = self.join_all(open_run)
                    out.append(struct.pack(f"<{len(whole)}I", *whole))
                    open_run = []
            else:
                out.append(ids)
        return b"".join(out)


_LOADED: dict[str | None, WordBpe] = {}


def word_bpe(path: str | None = None) -> WordBpe:
    """The vocabulary, loaded once in each worker. None: the installed word_bpe_49k.json."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])
DIGEST_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(bpe: WordBpe, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    sha = [hashlib.sha256(x).hexdigest() for x in ids]
    back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                       pa.array(sha, pa.string()), pa.array(back, pa.string())], schema=DIGEST)


def encode_text(docs: DataFrame, path: str | None = None, text: str = "text", as_ids: bool = False,
                long_chars: int = LONG_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text).

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256), or (doc_id, ids binary) with
    ``as_ids``. Null or empty text: no tokens. Rows that repeat a doc_id each give a row;
    other columns are not looked at. A text's ids meet in one row, as the text did."""
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.length("text") >= long_chars
    schema = "doc_id long, ids binary" if as_ids else DIGEST_SQL

    def out(bpe: WordBpe, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        if not as_ids:
            return _digest(bpe, doc_ids, ids)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def short(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield out(bpe, part.column("doc_id").to_pylist(), [bpe.encode(x) for x in part.column("text").to_pylist()])

    def cut(batches):
        bpe = word_bpe(path)
        names = ["rid", "doc_id", "no", "run", "kind", "text"]
        for batch in batches:
            for rid, doc_id, x in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
                rows = [(rid, doc_id, no, *p) for no, p in enumerate(bpe.parts(x, part_chars))] or [(rid, doc_id, 0, 0, 0, "")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names)

    def encode(batches):
        bpe = word_bpe(path)
        for batch in batches:
            ids = [bpe.part_ids(k, x) for k, x in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.binary())], ["rid", "doc_id", "no", "run", "kind", "ids"])

    def join(table: pa.Table) -> pa.Table:
        bpe = word_bpe(path)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("no", "run", "kind", "ids")), strict=True))
        return pa.Table.from_batches([out(bpe, table.column("doc_id").to_pylist()[:1], [bpe.joined([r[1:] for r in rows])])])

    direct = rows.where(~long).select("doc_id", "text").mapInArrow(short, schema)
    parts = rows.where(long).mapInArrow(cut, "rid long, doc_id long, no long, run long, kind int, text string")
    coded = (parts.repartition(F.col("rid"), F.col("no"))
             .mapInArrow(encode, "rid long, doc_id long, no long, run long, kind int, ids binary"))
    return direct.unionByName(coded.groupBy("rid").applyInArrow(join, schema))


def op1_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    from vidmart.llm.common import documents
    return encode_text(documents(spark, sf_dir, "doc_id", "text"))
