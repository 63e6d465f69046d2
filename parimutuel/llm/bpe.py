"""BPE encoding and decoding (operator 8) by forced-boundary splitting.

Two bytes that stand side by side inside no token of the vocabulary can never end
up in one token, so a word may be cut between them. The fragments are encoded on
their own (lowest merge rank first) and their tokens concatenated. The last
fragment of a word carries the vocabulary's end-of-word suffix.

Around that stands what the tokenizer file asks for: special tokens are found in
the raw text, the rest is composed (NFC), lower-cased character by character and
cut into words, and white space vanishes. The file has no decoder, so decoding
joins the tokens' own strings with blanks.

Defined results: a null or empty text has no tokens and decodes to the empty
string; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cache

import regex
from pyspark.sql import DataFrame

from .common import kept, map_texts

#: Encoded texts between blanks that each of the two halves of a worker's cache keeps.
KEEP = 150_000
#: Bits of a symbol's number, and what stands for a pair that no merge joins.
BITS, NEVER = 20, 1 << 60
MASK = (1 << BITS) - 1
#: Characters that Python takes for white space and the tokenizer does not.
NO_SPACE = re.compile("[\x1c-\x1f]")
#: Below these code points every one is assigned.
BEYOND = re.compile("[\u0378-\U0010ffff]")
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


@cache
def unassigned() -> re.Pattern:
    """Finds code points that Python's Unicode tables do not know yet; libraries differ on what they are."""
    unknown = [i for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn"]
    starts = [a for a, b in zip(unknown, [-2, *unknown]) if a != b + 1]
    ends = [b for b, a in zip(unknown, [*unknown[1:], -2]) if a != b + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]")


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a vocabulary whose words end in a suffix."""

    def __init__(self, tokenizer: dict):
        model = tokenizer["model"]
        self.spec, self.library = tokenizer, None
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        #: Token of each id, as a number and as text.
        self.tokens = {key: t for t, i in [*self.ids.items(), *self.special.items()] for key in (i, str(i))}
        letters = byte_letters()
        inside = {t[i : i + 2] for x in self.ids for t in [x.removesuffix(self.suffix)] for i in range(len(t) - 1)}
        #: Pairs of bytes that no token holds side by side.
        self.forced = {(a, b) for a, x in enumerate(letters) for b, y in enumerate(letters) if x + y not in inside}
        # Symbols are numbered: bytes, bytes that end a word, and what merges make of them.
        symbols: dict[str, int] = {}
        number = lambda t: symbols.setdefault(t, len(symbols))
        self.inner, self.last = [number(x) for x in letters], [number(x + self.suffix) for x in letters]
        #: For a pair of symbols the merge's rank above the number of what it makes.
        self.pairs = {number(a) << BITS | number(b): r << BITS | number(a + b) for r, (a, b) in enumerate(map(self.pair, model["merges"]))}
        #: A symbol's id as text; nothing where the vocabulary lacks it.
        self.names = [str(self.ids[t]) if t in self.ids else None for t in symbols]
        self.letters = letters
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: Ids of what recently stood between blanks, and before that; the older half goes when the recent one is full.
        self.kept: dict[str, str] = {}
        self.older: dict[str, str] = {}

    @staticmethod
    def pair(merge: list | str) -> tuple[str, str]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        return a, b

    def fragments(self, word: str) -> list[list[int]]:
        """The symbols of a word's fragments, cut at forced boundaries."""
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        cuts = [i for i, pair in enumerate(zip(raw, raw[1:]), 1) if pair in self.forced]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])] if cuts else [symbols]

    def merged(self, symbols: list[int]) -> list[int]:
        """Apply merges to one fragment, lowest rank first, leftmost among equals.

        Short fragments keep their pairs' merges in a list; a heap of pairs over a
        linked list keeps long ones at n log n.
        """
        if len(symbols) > 64:
            return self.merged_long(symbols)
        find, s = self.pairs.get, symbols
        merges = [find(a << BITS | b, NEVER) for a, b in zip(s, s[1:])]
        while merges and (best := min(merges)) != NEVER:
            i, one = merges.index(best), best & MASK
            s[i : i + 2] = [one]
            del merges[i]
            if i:
                merges[i - 1] = find(s[i - 1] << BITS | one, NEVER)
            if i < len(merges):
                merges[i] = find(one << BITS | s[i + 1], NEVER)
        return s

    def merged_long(self, symbols: list[int]) -> list[int]:
        from heapq import heapify, heappop, heappush

        n, s = len(symbols), symbols
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m, i, s[i], s[i + 1]) for i in range(n - 1) if (m := self.pairs.get(s[i] << BITS | s[i + 1])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            merge, i, a, b = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], after[i] = merge & MASK, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (m := self.pairs.get(s[x] << BITS | s[y])) is not None:
                    heappush(heap, (m, x, s[x], s[y]))
        return [x for x, live in zip(s, alive) if live]

    def word(self, word: str) -> str:
        """A word's ids, blank-joined."""
        return " ".join([name for f in self.fragments(word) for t in self.merged(f) if (name := self.names[t])])

    def chunk(self, chunk: str) -> str:
        """The ids of the words between two blanks."""
        if (out := self.older.get(chunk)) is None:
            out = " ".join(filter(None, map(self.word, WORDS.findall(chunk))))
        if len(self.kept) >= KEEP:
            self.older, self.kept = self.kept, {}
        if len(chunk) < 100:
            self.kept[chunk] = out
        return out

    def plain(self, text: str) -> str | None:
        """A text composed and lower-cased; nothing if it holds characters newer than Python's tables."""
        if not text.isascii():
            if BEYOND.search(text) and unassigned().search(text):
                return None
            # A capital sigma has one lower case here, wherever it stands.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def cut_by_library(self, text: str) -> list[str]:
        """Words by the tokenizer library's own Unicode tables, for characters newer than Python's."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
        of = {c: b for b, c in enumerate(self.letters)}
        plain = self.library.normalizer.normalize_str(text)
        return [bytes(of[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def told(self, text: str) -> list[str]:
        """The ids of a text, as texts. No word reaches over white space, so what lies between is looked up whole."""
        out: list[str] = []
        for k, part in enumerate(self.split.split(text) if any(t in text for t in self.special) else [text]):
            if k % 2:
                out.append(str(self.special[part]))
            elif part:
                plain = self.plain(part)
                if plain is None or NO_SPACE.search(plain):
                    out += map(self.word, self.cut_by_library(part) if plain is None else WORDS.findall(plain))
                else:
                    get = self.kept.get
                    out += [get(c) or self.chunk(c) for c in plain.split()]
        return " ".join(filter(None, out)).split()

    def encode(self, text: str) -> list[int]:
        return [*map(int, self.told(text))]

    def decode(self, ids: list[int] | list[str]) -> str:
        """The tokens of ids, as numbers or as text; unknown ids are left out."""
        return " ".join(filter(None, map(self.tokens.get, ids)))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids and of the text decoded from them."""
        ids = self.told(text)
        return len(ids), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def shared(path: str, spec: str) -> WordBpe:
    """The encoder that a worker keeps from task to task, as long as its passes encode."""
    mine = kept(__name__)
    if (path, spec) not in mine:
        mine[path, spec] = WordBpe(json.loads(spec))
    return mine[path, spec]


def per_document(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    """Apply ``row(bpe, text)`` to each text. The vocabulary file, whose size is fixed, is broadcast."""
    spec = docs.sparkSession.sparkContext.broadcast(json.dumps(load(path)))

    def run(ids, texts):
        bpe = shared(path, spec.value)
        return [ids, *(zip(*[row(bpe, t) for t in texts]))]

    return map_texts(docs, run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the token ids and the text decoded from them."""

    def row(bpe: WordBpe, text: str) -> tuple[list[int], str]:
        ids = bpe.encode(text)
        return ids, bpe.decode(ids)

    return per_document(docs, path, "doc_id long, ids array<int>, decoded string", row)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    return per_document(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", WordBpe.digest)
