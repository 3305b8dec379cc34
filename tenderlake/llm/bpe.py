"""Byte-pair encoding as a streaming transducer, and decoding by a state machine."""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of either of two generations that a worker keeps encoded, and the longest word that is kept.
CACHED_WORDS, CACHED_CHARS = 350_000, 40
#: A text is encoded and hashed in parts of about so many code points, cut at white space.
PART = 1 << 16

#: Lower-case Latin letters, in composed form: one piece for any version of Unicode.
PLAIN = regex.compile(r"[a-zß-öø-ÿ]+").fullmatch
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeList:
    """Vocabulary and merges of a tokenizer file, with the lookahead that they need.

    ``lookahead`` is the most symbols that one token spans. The encoding of a
    prefix is unique, and its last token starts at one of the last
    ``lookahead`` boundaries, so no state further back is ever consulted.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.never = len(self.rank)
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.bytes = byte_alphabet()
        self.byte_of = {c: b for b, c in self.bytes.items()}
        lacking = [c for c in self.bytes.values() if c not in self.ids or c + self.suffix not in self.ids]
        if lacking:
            raise ValueError(f"the vocabulary lacks the byte symbols {lacking[:5]}")
        self.lookahead = max(len(self.symbols(t)) for t in self.ids)
        self._made: dict[str, tuple[int, str, str] | None] = {}
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return [*token]

    def merge(self, parts: list[str]) -> list[str]:
        """The merges applied in order of rank, leftmost first."""
        rank, never = self.rank, self.never
        ranks = [rank.get(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != never:
            at = ranks.index(best)
            both = parts[at] + parts[at + 1]
            parts[at : at + 2] = [both]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((parts[at - 1], both), never)
            if at < len(ranks):
                ranks[at] = rank.get((both, parts[at + 1]), never)
        return parts

    def made(self, token: str) -> tuple[int, str, str] | None:
        """Rank and halves of the last merge that makes the token from its symbols; None if they don't make it."""
        if token not in self._made:
            parts, halves = self.symbols(token), ["", ""]
            got: tuple[int, str, str] | None = (-1, token, token) if len(parts) == 1 else None
            if len(parts) > 1:
                while len(parts) > 1:
                    best, at = min((self.rank.get(pair, self.never), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
                    if best == self.never:
                        break
                    halves = parts[at : at + 2]
                    parts[at : at + 2] = ["".join(halves)]
                    got = (best, *halves) if len(parts) == 1 else None
            self._made[token] = got if token in self.ids else None
        return self._made[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether the merges of both leave the boundary between them alone.

        Merges are taken back, the later of the two sides first; the pair at
        the boundary must not have merged before the one that is taken back.
        A pair of the same rank goes first if it stands further left.
        """
        bound = self.never
        while True:
            if self.rank.get((left, right), self.never) < bound:
                return False
            (a, _, inner_left), (b, inner_right, _) = self.made(left), self.made(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, bound = inner_left, a
            else:
                right, bound = inner_right, b + 1


class StreamingEncoder:
    """Tokens of one word, fed symbol by symbol; a token leaves once no continuation can change it.

    For each boundary in the window of the last ``lookahead`` ones it keeps
    the last token of the prefix that ends there. Every later token starts at
    a boundary of that window, so what all of them share further back is
    final and is emitted; memory is the window and what is not yet final.
    """

    def __init__(self, merges: MergeList):
        self.m = merges
        self.tail: list[str] = []  # symbols after the last emitted boundary
        self.last: list[str | None] = [None]  # by boundary: the token that ends there
        self.start: list[int] = [-1]  # by boundary: where that token starts
        self.edge: str | None = None  # the last token emitted
        self.held: str | None = None
        self.most = 0  # the most symbols ever held

    def _extend(self, symbol: str, final: bool) -> None:
        self.tail.append(symbol)
        n, suffix = len(self.tail), self.m.suffix if final else ""
        for i in range(max(0, n - self.m.lookahead), n):
            token = "".join(self.tail[i:n]) + suffix
            left = self.last[i] if i else self.edge
            if token in self.m.ids and self.m.made(token) and (left is None or self.m.fits(left, token)):
                self.last.append(token)
                self.start.append(i)
                return
        raise AssertionError("a prefix has no encoding")

    def _path(self, boundary: int) -> list[int]:
        out = []
        while boundary > 0:
            out.append(boundary)
            boundary = self.start[boundary]
        return out[::-1]

    def _emit(self, upto: int) -> list[str]:
        path = self._path(upto)
        out = [self.last[b] for b in path]
        if upto:
            self.edge = self.last[upto]
            self.tail = self.tail[upto:]
            self.last = [None, *self.last[upto + 1 :]]
            self.start = [-1, *(max(x - upto, 0) for x in self.start[upto + 1 :])]
        return out

    def push(self, symbol: str) -> list[str]:
        symbol, self.held = self.held, symbol  # the last symbol of a word merges differently
        if symbol is None:
            return []
        self._extend(symbol, False)
        n = len(self.tail)
        self.most = max(self.most, n)
        if n < 2 * self.m.lookahead or n % self.m.lookahead:
            return []
        shared = set(self._path(n))
        for boundary in range(n - self.m.lookahead + 1, n):
            shared &= {*self._path(boundary)}
        return self._emit(max(shared, default=0))

    def finish(self) -> list[str]:
        if self.held is None:
            return []
        self._extend(self.held, True)
        self.held = None
        return self._emit(len(self.tail))


class StreamingDecoder:
    """Text from token ids, one at a time.

    ``form="tokens"``: the vocabulary's strings, a space between two; a file
    without a decoder is decoded so. ``form="text"``: bytes of the tokens
    through an incremental UTF-8 decoder, a space after each end of word; a
    character may come in pieces, and what is not UTF-8 becomes U+FFFD.
    """

    def __init__(self, merges: MergeList, form: str = "tokens"):
        self.m, self.form, self.first = merges, form, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.byte = merges.byte_of

    def push(self, token_id: int) -> str:
        token = self.m.text[token_id]
        if self.form == "tokens":
            first, self.first = self.first, False
            return token if first else " " + token
        if token in self.m.special:
            return self.utf8.decode(b"", True) + token
        ends = bool(self.m.suffix) and token.endswith(self.m.suffix)
        body = bytes(self.byte[c] for c in (token[: -len(self.m.suffix)] if ends else token))
        return self.utf8.decode(body, ends) + " " * ends

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


class Tokenizer:
    """Texts to ids and back with a bounded cache of encoded words.

    The library's own normaliser and word split are used, for their Unicode
    tables; the merges are applied here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.m = MergeList(path)
        library = Library.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.decimal = {t: str(i) for t, i in self.m.ids.items()}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older = self.words

    def encode_piece(self, piece: str) -> list[str]:
        """Tokens of one word of byte symbols. A word that ends within the lookahead is all window, so its merges are applied at once; of a longer one tokens leave as they become final."""
        if len(piece) <= self.m.lookahead:
            return self.m.merge([*piece[:-1], piece[-1] + self.m.suffix])
        stream, out = StreamingEncoder(self.m), []
        for symbol in piece:
            out += stream.push(symbol)
        return out + stream.finish()

    def _word(self, word: str) -> tuple[int, str, str]:
        """A word that isn't among the newer ones: how many ids, the ids as decimals, the text that they decode to.

        Normalising changes each character by itself or composes neighbours
        without white space, so a word is normalised as it is within its text.
        Words of plain letters need no more than lower case.
        """
        if (got := self.older.get(word)) is None:
            body = word[:-1] if len(word) > 1 and word[-1] in ".," else word
            if body.isascii() and body.isalpha():
                pieces = [body.lower()]
            elif PLAIN(body):
                pieces = ["".join(map(self.m.bytes.__getitem__, body.encode()))]
            else:
                body, pieces = word, [piece for piece, _ in self.split(self.normal(word))]
            tokens = [t for piece in (pieces if body is word else [*pieces, word[-1]]) for t in self.encode_piece(piece)]
            state = StreamingDecoder(self.m)
            got = len(tokens), " ".join(map(self.decimal.__getitem__, tokens)), "".join([state.push(self.m.ids[t]) for t in tokens]) + state.finish()
        if len(word) <= CACHED_CHARS:
            if len(self.words) >= CACHED_WORDS:
                self.words, self.older = {}, self.words
            self.words[word] = got
        return got

    def pieces(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """By parts of the text, for each word with tokens: how many, the ids as decimals, the decoded form."""
        begin = 0
        while begin < len(text):
            after = SPACE.search(text, begin + PART) if begin + PART < len(text) else None
            end = after.start() if after else len(text)
            out = []
            for i, part in enumerate(self.m.marks.split(text[begin:end])):
                if i % 2:
                    out.append((1, str(self.m.special[part]), part))
                    continue
                if part.isascii():
                    part = part.lower()
                words, look = SPACE.split(part) if ODD_SPACE.search(part) else part.split(), self.words.get
                out += [look(w) or self._look(w) for w in words if w]
            yield [x for x in out if x[0]]
            begin = end

    def _look(self, word: str) -> tuple[int, str, str]:
        return self.words.get(word) or self._word(word)

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.pieces(text) for x in part for i in x[1].split(" ")]

    def decode(self, ids: list[int] | tuple[int, ...], form: str = "tokens") -> str:
        state = StreamingDecoder(self.m, form)
        return "".join(map(state.push, ids)) + state.finish()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: its id, ``n_tokens``, ``ids``, and digests of the ids and of the decoded text.

    Words leave the transducer as tokens and come back through the decoder's
    state machine; both are remembered by word, in a bounded store. A text is
    taken in parts, whose ids and decoded text go straight into the digests.

    Null and empty texts have no tokens; null ids pass through; a word of any
    length is encoded in constant memory beside it; repeated rows are encoded
    alike; an empty table gives an empty table; other columns are not read.
    ``with_ids=False`` leaves ``ids`` null.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            n, ids, digests = [], [], ([], [])
            for text in batch.column(1):
                count, listed, hashes = 0, [] if with_ids else None, (hashlib.sha256(), hashlib.sha256())
                for part in tok.pieces(text.as_py() or ""):
                    if part:
                        gap = " " if count else ""
                        for which, sha in enumerate(hashes, 1):
                            sha.update((gap + " ".join([x[which] for x in part])).encode())
                        count += sum([x[0] for x in part])
                        if with_ids:
                            listed += [int(i) for x in part for i in x[1].split(" ")]
                n.append(count)
                ids.append(listed)
                for out, sha in zip(digests, hashes, strict=True):
                    out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), *(pa.array(x, pa.string()) for x in digests)],
                ["_doc", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    out = own.mapInArrow(rows, "_doc long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_doc", id_col)
