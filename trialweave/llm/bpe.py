"""Word-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from trialweave.functions.ship import map_arrow
from trialweave.llm.common import small_batches

#: Characters in a block of text; blocks end at white space.
BLOCK = 1 << 20
#: Distinct words whose ids are remembered, and the longest such word.
REMEMBERED, LONGEST = 1 << 19, 64

_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_L = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: For texts below U+0250 the classes are spelled out, so the faster module serves.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_WS}{_L}{_N}]+")
_BEYOND = re.compile(r"[^\x00-\u024f]")
_SPACE = re.compile(rf"[{_WS}]")


@functools.cache
def _any_word():
    import regex

    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WS}\p{{L}}\p{{N}}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


class WordBpe:
    """The tokenizer in a vocabulary file of kind "BPE with word ends"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        chars = byte_characters()
        self.inside = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        shift, kind = (16, np.uint32) if len(self.tokens) <= 1 << 16 else (32, np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], kind)
        right = np.array([vocab[b] for _, b in model["merges"]], kind)
        self.shift, keys = kind(shift), left << kind(shift) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], kind)
        self.inside, self.last = self.inside.astype(kind), self.last.astype(kind)
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        #: A character of all special tokens, if they share one: texts without it need no search.
        self.mark = next((c for c in min(self.added, key=len) if all(c in t for t in self.added)), "") if self.added else ""
        self.known: dict[str, bytes] = {}
        self.spelled: dict[bytes, str] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (_any_word() if not text.isascii() and _BEYOND.search(text) else _LATIN).findall(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair by binary search, or the number of merges if it has none."""
        keys = left << self.shift | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(len(self.merged)))

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers.

        The symbols of all words lie in one flat array.  A round takes each word's pair of
        lowest rank, merges all its occurrences from the left, and ranks the pairs that are
        new beside them; words without a pair leave.
        """
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inside[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        none = len(self.merged)
        ranks = np.full(len(symbols), none, np.int32)
        ranks[:-1] = np.where(word[:-1] == word[1:], self.rank(symbols[:-1], symbols[1:]), none)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(ranks, starts)
            lowest = np.repeat(best, np.diff(starts, append=len(symbols)))
            live = lowest < none
            if not live.all():
                done.append((word[~live], symbols[~live]))
            places = np.flatnonzero((ranks == lowest) & live)
            if len(places) > 1:  # of overlapping places, every other one from the left
                fresh = np.diff(places, prepend=-2) != 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            symbols[places] = self.merged[ranks[places]]
            live[places + 1] = False
            moved = (np.cumsum(live) - 1)[places]
            symbols, word, ranks = symbols[live], word[live], ranks[live]
            if not len(symbols):
                break
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            ranks[changed] = none
            pairs = changed[changed < len(symbols) - 1]
            pairs = pairs[word[pairs] == word[pairs + 1]]
            ranks[pairs] = self.rank(symbols[pairs], symbols[pairs + 1])
        if not done:
            return []
        order = np.argsort(np.concatenate([w for w, _ in done]), kind="stable")
        ids = np.concatenate([s for _, s in done])[order].astype("<u4").tobytes()
        cuts = np.bincount(np.concatenate([w for w, _ in done]), minlength=len(raw))
        cuts = [0, *(4 * np.cumsum(cuts)).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words) -> dict[str, bytes]:
        """The ids of new ``words`` as little-endian 32-bit integers; common words are remembered."""
        new = list(words)
        found = dict(zip(new, self.merge(new)))
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
            self.spelled.clear()
        self.known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return found

    def pieces(self, text: str):
        """Lists of words, or a special token's id, in order; each list is of a block at most."""
        at = 0
        while at < len(text):
            special = self.special.search(text, at) if self.special and self.mark in text else None
            stop = special.start() if special else len(text)
            while at < stop:
                end = stop
                if stop - at > BLOCK and (space := _SPACE.search(text, at + BLOCK, stop)):
                    end = space.start()
                yield self.words(text[at:end])
                at = end
            if special:
                yield self.added[special.group()]
                at = special.end()

    def encoded(self, texts: list[str]) -> list[list]:
        """For each text the ids of its words (bytes objects), as lists for each block."""
        out, open_, new = [], [], {}
        known = self.known.get
        for t in texts:
            out.append(own := [])
            for x in self.pieces(t):
                own.append([x.to_bytes(4, "little")] if isinstance(x, int) else list(map(known, x)))
                if not all(own[-1]):  # a word's ids are never empty
                    open_.append((own, len(own) - 1, x))
                    new.update((w, None) for w, ids in zip(x, own[-1]) if ids is None)
        if new:
            found = self.learn(new)
            for own, k, x in open_:
                own[k] = [found[w] if ids is None else ids for w, ids in zip(x, own[k])]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(b for x in self.encoded([text])[0] for b in x), "<u4")

    def decode(self, ids) -> str:
        """Tokens by id, joined by spaces, as a tokenizer without a decoder gives them; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))

    def spell(self, ids: bytes) -> str:
        """:meth:`decode` of a word's ids, remembered."""
        if (out := self.spelled.get(ids)) is None:
            if len(self.spelled) >= REMEMBERED:
                self.spelled.clear()
            self.spelled[ids] = out = self.decode(np.frombuffer(ids, "<u4"))
        return out


@functools.cache
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``path`` is a vocabulary file that every executor can open (an installed package's).
    Texts go through in blocks cut at white space, where no token crosses, so memory does
    not grow with a text's words beyond its own ids.  A null text counts as empty: no
    tokens and the digests of nothing.  Equal texts have equal values; rows never meet, so
    repeated rows, null ids and other columns have no effect.  An empty table gives an
    empty result.
    """
    path = path or default_path()
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(path)
        for batch in small_batches(batches, 1):
            counts, ids, decoded = [], [], []
            for blocks in bpe.encoded([t or "" for t in batch.column(1).to_pylist()]):
                a, b, n, gap = hashlib.sha256(), hashlib.sha256(), 0, b""
                for block in blocks:
                    raw = b"".join(block)
                    n += len(raw) // 4
                    a.update(raw)
                    if block:
                        b.update(gap + " ".join(map(bpe.spell, block)).encode("utf-8"))
                        gap = b" "
                counts.append(n)
                ids.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = map_arrow(chosen, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
