"""BPE encoding and decoding of whole texts with batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array.  A round looks every adjacent pair up by binary
search over the sorted pair keys, takes each word's lowest rank, and joins all its pairs of that rank at once,
left to right.  Words with no pair left leave the array.  White space never joins two words, so texts are split
at it first and each distinct word is encoded once while a worker's bounded table
holds it.

What a letter, a number or a capital is depends on the Unicode version of whoever asks.  So a character beyond ASCII is
put to the library's own normaliser and pre-tokenizer when a worker first meets it; tokens with one on which they and the
rules here disagree, or that is younger than the normal forms that all versions share, are encoded by the library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import Recent, map_texts, table, texts

#: Entries in each of the two generations of a worker's tables.
TABLE_WORDS = 250_000
#: Fixed values of the vocabulary's own format: how a text splits into words, and its white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
#: str.split() also splits at these, which are no white space in Unicode.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Marks that end a token and are one word after a letter.
MARKS = ".,;:!?#$%&*"
#: A line of letters and marks alone, or any other.
PLAIN = re.compile(rf"([^\W\d_]+)([{re.escape(MARKS)}]*)\n|(.*)\n")
NO_RANK = np.int64(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


def normal(text: str) -> str:
    """The vocabulary's normal form, but for white space: composed, and each character in lower case by itself."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def library(path: str):
    """The library's own tokenizer of a vocabulary file, without truncation or padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def parts(library, text: str) -> list[str]:
    """The words that the library's pre-tokenizer cuts a normalised text into."""
    spans = (at for _, at in library.pre_tokenizer.pre_tokenize_str(text))
    return [text[a:b] for a, b in spans]


class Bpe:
    """A vocabulary file of the word-end kind: ids of words, and words of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in (vocab | self.special).items():
            self.token[i] = name
        self.known, self.words = Recent(TABLE_WORDS), Recent(TABLE_WORDS)
        self.library, self.alike, self.letters = library(path), {}, set()

    def look_up(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pairs that begin at ``at``; a word's last symbol begins none."""
        nxt = np.minimum(at + 1, len(ids) - 1)
        pair = ids[at] << 32 | ids[nxt]
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        is_pair = (self.keys[place] == pair) & (nxt > at) & (word[at] == word[nxt])
        return np.where(is_pair, self.rank[place], NO_RANK), self.made[place]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (of one byte at least), as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.inner[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        word, done = np.repeat(np.arange(len(words)), lengths), []
        rank, product = self.look_up(ids, word, np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            over = lowest == NO_RANK
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, product, lowest = (x[~over] for x in (ids, word, rank, product, lowest))
                if not len(ids):
                    break
            # of pairs that overlap, as in aaa, each second one from the left
            places = np.flatnonzero(rank == lowest)
            run = np.flatnonzero(np.r_[True, np.diff(places) != 1])
            places = places[(np.arange(len(places)) - np.repeat(run, np.diff(np.r_[run, len(places)]))) % 2 == 0]
            ids[places] = product[places]
            stay = np.ones(len(ids), bool)
            stay[places + 1] = False
            ids, word, rank, product = (x[stay] for x in (ids, word, rank, product))
            # only pairs with a new symbol have changed
            places -= np.arange(len(places))
            fresh = np.r_[places, places[places > 0] - 1]
            rank[fresh], product[fresh] = self.look_up(ids, word, fresh)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def agrees(self, c: str) -> bool:
        """Whether the library takes this character as the rules here do, between others of each kind."""
        own = self.alike.get(c)
        if own is None:
            known = unicodedata.ucd_3_2_0.category(c) != "Cn"
            forms = (c, f"a{c}a", f"!{c}!", f"1{c}1")
            own = self.alike[c] = known and all(self.library.normalizer.normalize_str(x) == SPACE.sub(" ", normal(x)) and parts(self.library, normal(x)) == WORDS.findall(normal(x)) for x in forms)
        return own

    def is_letter(self, c: str) -> bool:
        """Whether a character is a letter to the library, too, and stays one in the normal form whatever stands beside it."""
        return c != "Σ" and c.isalpha() and self.agrees(c) and normal(c).isalpha()

    def cut(self, token: str) -> list[str | int] | None:
        """The words of a token without white space, in its normal form, and ids of special tokens; None if the library
        must be asked."""
        if not token.isascii() and not all(map(self.agrees, token)):
            return None
        out: list[str | int] = []
        for piece in self.at_special.split(token) if "<|" in token else (token,):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            out += WORDS.findall(normal(piece))
        return out

    def learn(self, tokens: set[str]) -> None:
        """Put the ids of these texts, which hold no white space, into the table."""
        own, letters = list(tokens), self.letters
        beyond = {c for c in set("".join(own)) if not c.isascii()}
        letters |= {c for c in beyond - letters if self.is_letter(c)}
        others = beyond - letters
        slow = [] if not others else [t for t in own if not others.isdisjoint(t)]
        own = own if not others else [t for t in own if others.isdisjoint(t)]
        # most tokens are letters that stay letters, and perhaps marks: two words at most, found in all of them at once
        found = PLAIN.findall(normal("\n".join(own)) + "\n") if own else []
        slow += [t for t, (_, _, rest) in zip(own, found, strict=True) if rest]
        parts = [(t, self.cut(t)) for t in slow]
        met = {x for w, end, _ in found for x in (w, end)}
        met.update(w for _, cut in parts for w in cut or () if isinstance(w, str))
        met.discard("")
        fresh = list(self.words.missing(met))
        self.words.update(zip(fresh, self.merge([w.encode() for w in fresh]), strict=True))
        get = self.words.__getitem__
        self.known.update((t, get(w) + get(end) if end else get(w) if w else b"") for t, (w, end, _) in zip(own, found, strict=True))
        for token, cut in parts:
            if cut is None:
                self.known[token] = np.array(self.library.encode(token, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            self.known[token] = get(cut[0]) if len(cut) == 1 and isinstance(cut[0], str) else b"".join(get(w) if isinstance(w, str) else w.to_bytes(4, "little") for w in cut)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [t.split() if not NOT_SPACE.search(t) else SPACE.split(t) for t in batch]
        self.learn(self.known.missing(set().union(*split)))
        return [b"".join(map(self.known.__getitem__, own)) for own in split]

    def decode(self, ids: bytes) -> str:
        """The tokens of ids, which the vocabulary's format joins by a space, special ones included."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every whole text; null or empty text: no ids."""

    def work(piece, path):
        return {"doc_id": piece.column("doc_id"), "ids": bpe(path).encode(piece.column("text").to_pylist())}

    return map_texts(texts(docs), work, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary", path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, and its ids decoded.

    A null text counts as empty: no ids, and the digests of nothing.  Repeated rows stay repeated; an empty
    table gives an empty result; other columns are ignored.
    """

    def work(piece, path):
        own = bpe(path)
        ids = own.encode(piece.column("text").to_pylist())
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return {"doc_id": piece.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [digest(x) for x in ids], "decoded_sha256": [digest(own.decode(x).encode()) for x in ids]}

    return map_texts(texts(docs), work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents", spread=True), vocabulary("word_bpe_49k.json"))
