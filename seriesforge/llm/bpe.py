"""Byte-pair encoding and decoding of whole texts (operator 1).

A pre-token's merges run on a segment tree over its adjacent pairs: leaf ``i`` holds
``rank << 32 | i`` of the pair that starts at symbol ``i`` (or "no merge"), every inner node the
smaller of its children, so the root is always the leftmost pair of the lowest rank. A merge
changes three leaves, each updated in logarithmic time; the loop ends when the root has no pair.
The trees of a piece's new pre-tokens stand side by side in arrays and take their merges together;
those of over ``BESIDE`` symbols have a tree of their own.
Finished pre-tokens are kept in a bounded two-generation cache of the Python worker.

Defined results: a null text is the empty text; an empty text has no ids and decodes to the empty
string; repeated rows each give their row; other columns of the input pass through untouched.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from seriesforge.llm.common import small_batches

#: The pre-token patterns that the two public vocabularies use.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Rows of a batch that leaves a task.
BATCH = 256
#: Code points probed at a time.
PROBE = 1 << 12
#: Code points of the texts whose new pre-tokens are merged together.
PIECE = 1 << 20
#: Symbols of the longest pre-token whose tree stands beside others, and tree nodes held at a time.
BESIDE = 65
NODES = 1 << 16
NO_MERGE = 1 << 62
POSITION = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The printable letter of each byte value: printable Latin-1 stands for itself, the rest
    follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(own))
    return [letters[b] for b in range(256)]


def folded(text: str) -> str:
    """NFC, then each code point in lower case on its own (no context rules), by Python's tables."""
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def library_rules(path: str):
    """The library's normalizer and pre-tokenizer of a vocabulary file. The vocabulary itself isn't
    loaded into the library: what it takes would stay with the process."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"vocab": {}, "merges": []}
    rules = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None}))
    return rules.normalizer, rules.pre_tokenizer


@lru_cache(maxsize=2)
def unlike(path: str) -> dict[str, str]:
    """Code points that the library's Unicode tables treat otherwise than Python's, by what the
    library's pre-tokenizer takes them for: L, N, S(pace) or O(ther). All code points are probed:
    among letters (other signs) of its own kind each joins the run, and only the odd ones part it."""
    fold, split = library_rules(path)
    odd, changed = set(), {}
    for first in range(0, 0x110000, PROBE):
        every = "".join(chr(c) for c in range(first, first + PROBE) if not 0xD800 <= c < 0xE000)
        letters, known = set(regex.findall(r"\p{L}", every)), set(regex.findall(r"[\p{N}\s]", every))
        odd |= known
        for among, points in (("a", letters), ("!", set(every) - letters - known)):
            text = among + "".join(c + among for c in points)
            joined = [False] * len(text)
            for _, (start, end) in split.pre_tokenize_str(text):
                if end - start > 1:
                    joined[start:end] = [True] * (end - start)
            odd |= {c for c, j in zip(text, joined) if not j and c != among}
        before = [c for c in every if c != "!" and not c.isspace()]
        if before:
            text = "!".join(before)
            ours, theirs = folded(text).split("!"), fold.normalize_str(text).split("!")
            odd |= {c for c, x, y in zip(before, ours, theirs, strict=True) if x != y}
            changed |= {c: x for c, x in zip(before, ours) if x != c}
    odd |= {c for c, x in changed.items() if not odd.isdisjoint(x)}
    kinds = {1: "L", 2: "S", 3: "O", 4: "N"}  # pre-tokens of a code point that stands twice between two letters
    found = {c: kinds[len(split.pre_tokenize_str(f"a{c}{c}b"))] for c in odd}
    own = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "S": regex.compile(r"\s")}
    usual = {c: next((k for k, p in own.items() if p.match(c)), "O") for c in odd}
    other = {c for c in odd if found[c] != usual[c]}
    return {c: found[c] for c in odd if c in other or found[c] != "S" and (folded(c) != fold.normalize_str(c) or not other.isdisjoint(folded(c)))}


@lru_cache(maxsize=2)
def unlike_bytes(path: str) -> dict[str, str]:
    """``unlike`` for a byte-level vocabulary: what its pre-tokenizer takes a code point for where Python's
    tables say otherwise. A code point joins its neighbours if it is of their kind: letters, numbers or
    other signs; white space joins none. ASCII is the same in both."""
    split, found = library_rules(path)[1], {}
    for first in range(0x80, 0x110000, 0x80):
        every = [chr(c) for c in range(first, first + 0x80) if not 0xD800 <= c < 0xE000]
        whole = "".join(every)
        kind = dict.fromkeys(every, "S")
        for name, among in ("O", "!"), ("L", "a"), ("N", "1"):
            if len(split.pre_tokenize_str(among + whole)) == 1:  # all of them are of this kind
                kind = dict.fromkeys(every, name)
                break
            text = among + "".join(c + among for c in every)
            for _, (start, end) in split.pre_tokenize_str(text):
                if end - start > 1:
                    kind |= dict.fromkeys(set(text[start:end]) - {among}, name)
        own = {c: n for n, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")) for c in regex.findall(p, whole)}
        found |= {c: k for c, k in kind.items() if k != own.get(c, "O")}
    return found


def ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    points = sorted(points)
    first = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    last = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


def exact_pattern(odd: dict[str, str], pattern: str = WORD_PATTERN) -> str:
    """``pattern`` with the library's letters, numbers and spaces."""

    def kind(base: str, name: str) -> str:
        more = ranges([ord(c) for c, k in odd.items() if k == name])
        less = ranges([ord(c) for c, k in odd.items() if k != name])
        return f"[[{base}{more}]--[{less}]]" if less else f"[{base}{more}]"

    letter, number, space = kind(r"\p{L}", "L"), kind(r"\p{N}", "N"), kind(r"\s", "S")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}||{letter}||{number}]").replace(r"\S", f"[^{space}]")
    for base, exact in (r"\p{L}", letter), (r"\p{N}", number), (r"\s", space):
        pattern = pattern.replace(f"[{base}]", exact).replace(f"{base}+", f"{exact}+")
    return pattern


class Generations(dict):
    """A bounded cache: when the young generation is full it becomes the old one, whose entries
    return when they are used again. ``make`` computes an entry that neither has."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self[key] = value
        return value

    def forget(self) -> None:
        """Gives back the memory of both generations."""
        self.clear()
        self.old = {}

    def lacking(self, keys: set) -> list:
        """Which of ``keys`` neither generation has; those that the old one has return to the young."""
        keys = [k for k in keys if k not in self]
        self.update((k, self.old[k]) for k in keys if k in self.old)
        return [k for k in keys if k not in self.old]

    def turn(self) -> None:
        """Called between texts."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes with a public BPE vocabulary file (JSON)."""

    def __init__(self, path: str, odd: dict[str, str] | None = None, cache_entries: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.pairs: dict[int, int] = {}
        self.results: list[int] = []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs[self.vocab[left] << 24 | self.vocab[right]] = len(self.results)
            self.results.append(self.vocab[left + right])
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys = np.append(keys, np.int64(1 << 62))
        self.pair_ranks = np.append(np.array([self.pairs[k] for k in keys.tolist()], np.int64), 0) << 32
        self.pair_results = np.array(self.results, np.int64)
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.final = [self.vocab.get(c + self.suffix) for c in letters]
        self.first = np.array([[-1 if i is None else i for i in kind] for kind in (self.inner, self.final)], np.int64)
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}
        self.normalizer = library_rules(path)[0]
        self.bytes_back = spec["decoder"] is not None
        self.byte_of = {c: b for b, c in enumerate(letters)}
        pattern = WORD_PATTERN if self.suffix else BYTE_PATTERN
        self.pre_token = regex.compile(pattern)
        if odd is None:
            odd = unlike(path) if self.suffix else unlike_bytes(path)
        self.odd = frozenset(odd)
        self.exact = regex.compile(exact_pattern(odd, pattern), regex.V1)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")
        self.known = Generations(self._entry, cache_entries)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens, normalised as the library does."""
        usual = text.isascii() or self.odd.isdisjoint(text)
        if self.normalizer is not None:
            text = folded(text) if usual else self.normalizer.normalize_str(text)
        return (self.pre_token if usual else self.exact).findall(text)

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids left when no adjacent pair can be merged."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs, results = self.pairs, self.results
        size = 1 << (n - 2).bit_length()
        tree = [NO_MERGE] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(symbols[i] << 24 | symbols[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while (top := tree[1]) != NO_MERGE:
            at = top & POSITION
            gone = after[at]
            symbols[at], symbols[gone] = results[top >> 32], -1
            right = after[at] = after[gone]
            if right < n:
                before[right] = at
            left = before[at]
            changed = [(gone, NO_MERGE), (at, self._leaf(symbols, at, right, n))]
            if left >= 0:
                changed.append((left, self._leaf(symbols, left, at, n)))
            for i, value in changed:
                i += size
                if i >= 2 * size or tree[i] == value:
                    continue
                tree[i] = value
                while i > 1:
                    other = tree[i ^ 1]
                    i >>= 1
                    if value > other:
                        value = other
                    if tree[i] == value:
                        break
                    tree[i] = value
        return [s for s in symbols if s >= 0]

    def _leaf(self, symbols: list[int], left: int, right: int, n: int) -> int:
        if right >= n:
            return NO_MERGE
        rank = self.pairs.get(symbols[left] << 24 | symbols[right])
        return NO_MERGE if rank is None else rank << 32 | left

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaves of the pairs of symbols that start at ``at``; -1 is no symbol."""
        keys = (left << 24) | right
        found = self.pair_keys.searchsorted(keys)
        return np.where((self.pair_keys[found] == keys) & (left >= 0), self.pair_ranks[found] | at, NO_MERGE)

    def _merge_beside(self, symbols: np.ndarray, depth: int) -> np.ndarray:
        """``merge`` of each column, -1 after its end; the trees have 2 ** depth leaves. Row p of the
        result is the symbol that starts at p, or -1."""
        size, m = 1 << depth, symbols.shape[1]
        # Symbols from row 1 on: before and after them stand rows of none.
        own = np.full((size + 4, m), -1, np.int64)
        own[1 : len(symbols) + 1] = symbols
        tree = np.empty((2 * size, m), np.int64)
        tree[size:] = self._leaves(own[1 : size + 1], own[2 : size + 2], np.arange(1, size + 1)[:, None])
        for level in range(depth - 1, -1, -1):
            a, b = 1 << level, 2 << level
            np.minimum(tree[b : 2 * b : 2], tree[b + 1 : 2 * b : 2], out=tree[a:b])
        before, after = (np.repeat(np.arange(size + 4) + step, m) for step in (-1, 1))
        own, tree, rows = own.ravel(), tree.ravel(), np.arange(m)
        while True:
            top = tree[m + rows]
            live = top != NO_MERGE
            if not live.all():
                top, rows = top[live], rows[live]
            if not len(rows):
                return own.reshape(size + 4, m)[1 : len(symbols) + 1]
            at = top & POSITION
            here = at * m + rows
            gone = after[here]
            away = gone * m + rows
            right = after[away]
            own[here], own[away] = self.pair_results[top >> 32], -1
            after[here] = right
            next_to = right * m + rows
            before[next_to] = at
            left = before[here]
            x = own[here]
            n = len(rows)
            made = self._leaves(np.concatenate([x, own[left * m + rows]]), np.concatenate([own[next_to], x]), np.concatenate([at, left]))
            # A pair that would start before the first or at the last symbol has no leaf: ``at`` is put twice.
            no_left, last = left == 0, gone > size
            nodes = np.concatenate([np.where(last, at, gone), at, np.where(no_left, at, left)]) + (size - 1)
            values = np.concatenate([np.where(last, made[:n], NO_MERGE), made[:n], np.where(no_left, made[:n], made[n:])])
            columns = np.concatenate([rows, rows, rows])
            tree[nodes * m + columns] = values
            for _ in range(depth):
                nodes >>= 1
                child = nodes * (2 * m) + columns
                tree[nodes * m + columns] = np.minimum(tree[child], tree[child + m])

    def _entries(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """``_entry`` of each word."""
        out: list = [None] * len(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for k in np.flatnonzero(sizes > BESIDE):
            out[k] = self._entry(words[k])
        least = 0
        for depth in range((BESIDE - 1).bit_length()):
            most = (1 << depth) + 1
            chosen, least = np.flatnonzero((sizes > least) & (sizes <= most)), most
            step = NODES >> (depth + 1)
            for a in range(0, len(chosen), step):
                part = chosen[a : a + step]
                n = sizes[part]
                ends = np.cumsum(n)
                data = np.frombuffer(b"".join([raw[k] for k in part]), np.uint8)
                found = self.first[0][data]
                found[ends - 1] = self.first[1][data[ends - 1]]
                column = np.repeat(np.arange(len(part)), n)
                place = np.arange(len(data)) - np.repeat(ends - n, n)
                if (found < 0).any():  # bytes without a token are left out
                    have = found >= 0
                    passed = np.cumsum(have)
                    place = passed - 1 - np.repeat(np.append(0, passed)[ends - n], n)
                    found, column, place = found[have], column[have], place[have]
                symbols = np.full((most, len(part)), -1, np.int64)
                symbols[place, column] = found
                left = self._merge_beside(symbols, depth).T
                some = left >= 0
                ids = left[some]
                stops = np.cumsum(some.sum(1)).tolist()
                packed, names, at = ids.astype("<u4").tobytes(), [] if self.bytes_back else [*map(self.token_bytes.__getitem__, ids.tolist())], 0
                for k, stop in zip(part.tolist(), stops):
                    out[k] = packed[4 * at : 4 * stop], b" ".join(names[at:stop])
                    at = stop
        return out

    def _entry(self, word: str) -> tuple[bytes, bytes]:
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        symbols = [inner[b] for b in raw[:-1]]
        symbols.append(self.final[raw[-1]])
        ids = self.merge([s for s in symbols if s is not None])
        return struct.pack(f"<{len(ids)}I", *ids), b"" if self.bytes_back else self.decode(ids).encode()

    def decode(self, ids) -> str:
        """The text of ids, special tokens included: token strings joined by spaces, or, for a
        byte-level decoder, the bytes that their letters stand for."""
        tokens = [self.tokens[i] for i in ids if i in self.tokens]
        if not self.bytes_back:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            out += bytes(map(self.byte_of.__getitem__, t)) if all(c in self.byte_of for c in t) else t.encode()
        return out.decode("utf-8", "replace")

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """``encode`` of each text; pre-tokens that are new are merged together, some texts at a time."""
        out: list[tuple[bytes, str]] = []
        while len(out) < len(texts):
            first, held, split = len(out), 0, []
            while first + len(split) < len(texts) and (not split or held < PIECE):
                text = texts[first + len(split)]
                held += len(text)
                split.append(None if any(s in text for s in self.specials) else self.words(text))
            new = self.known.lacking(set().union(*(w for w in split if w)))
            self.known.update(zip(new, self._entries(new)))
            for k, words in enumerate(split):
                out.append(self.encode(texts[first + k], False) if words is None else self._joined([*map(self.known.__getitem__, words)]))
            for w in new:
                if len(w) > self.known.longest:
                    del self.known[w]
            self.known.turn()
        return out

    def _joined(self, entries: list[tuple[bytes, bytes]]) -> tuple[bytes, str]:
        packed = b"".join(map(itemgetter(0), entries))
        if self.bytes_back:
            return packed, self.decode(memoryview(packed).cast("I").tolist())
        return packed, b" ".join(filter(None, map(itemgetter(1), entries))).decode()

    def encode(self, text: str, turn: bool = True) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
        entries = []
        pieces = self.special_split.split(text) if any(s in text for s in self.specials) else [text]
        for piece in pieces:
            special = self.specials.get(piece)
            if special is not None:
                entries.append((special.to_bytes(4, "little"), piece.encode()))
            elif piece:
                entries += map(self.known.__getitem__, self.words(piece))
        if turn:
            self.known.turn()
        return self._joined(entries)


@lru_cache(maxsize=2)
def codec(path: str, odd: tuple[tuple[str, str], ...] | None = None) -> Codec:
    """One codec for each worker and file."""
    return Codec(path, None if odd is None else dict(odd))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` (their text).
    One narrow pass over the rows, with no shuffle; results leave a task in small batches."""
    kept = [c for c in df.columns if c not in (ids, decoded) and (keep_text or c != text)]
    small_batches(df.sparkSession)
    at = [df.columns.index(c) for c in kept]
    where = df.columns.index(text)
    with open(vocabulary, encoding="utf-8") as f:
        odd = tuple((unlike if json.load(f)["model"].get("end_of_word_suffix") else unlike_bytes)(vocabulary).items())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, odd)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                out = c.encode_all([t.as_py() or "" for t in part.column(where)])
                made = pa.array([i for i, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in at), *made], [*kept, ids, decoded])
        c.known.forget()  # the worker may serve other operators next

    fields = [df.schema.fields[k] for k in at]
    return df.mapInArrow(encoded, T.StructType([*fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of ``ids`` as ``encode`` packs them; null ids are the empty list."""

    @F.arrow_udf(T.StringType())
    def text_of(packed: pa.Array) -> pa.Array:
        c = codec(vocabulary, ())  # decoding needs no pre-tokens
        return pa.array([c.decode(memoryview(p.as_py() or b"").cast("I").tolist()) for p in packed], pa.string())

    return df.withColumn(decoded, text_of(F.col(ids)))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded with the 49k word vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
