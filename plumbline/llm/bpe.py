"""Byte pair encoding and decoding with the vocabulary of a tokenizer file.

The last token of a prefix's encoding is unique, so one pass over a word finds
the encoding of all its prefixes: of the vocabulary entries that end at a
position (an automaton with failure links lists them), exactly one forms a pair
with the last token of the prefix before it that the merges leave as it is.
Back-pointers give the ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField
from tokenizers import Tokenizer

from plumbline.llm.frames import over_texts, worker_table

#: entries of a worker's cache of encoded pieces, and the longest piece it keeps
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
#: letters of the texts that are looked up together, and of the words that go to the library in one call
STEP_CHARS, CALL_CHARS = 1 << 21, 1 << 16
#: code points on which Python and the tokenizer agree in normalising, cutting and lower-casing;
#: texts with others are normalised and cut by the tokenizer's own components
USUAL = "\t-\r -~\x80-ɏЀ-ҁ‐-‧€一-鿿"
USUAL_TEXT = re.compile(f"[{USUAL}]*")
#: the blanks among them; nothing is composed, lower-cased or cut across one
BLANKS = re.compile("[\t-\r \x85\xa0]+")
#: what the vocabulary with word ends takes as words; the tokenizer file states it too
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level tokenizers."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Entries and merges of a tokenizer file, and the encoding of single words."""

    #: a word's last symbol is moved up by this much where the vocabulary marks word ends
    END = 0xE000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        if any(a.get("normalized") or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec.get("added_tokens", [])):
            raise ValueError("only literal added tokens are supported")
        self.tokens |= {i: t for t, i in self.special.items()}
        self.symbols = {i: self._symbol(t) for t, i in model["vocab"].items()}
        ids = {s: i for i, s in self.symbols.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = ids[self._symbol(left)], ids[self._symbol(right)]
            made = ids[self._symbol(left) + self._symbol(right)]
            if made in self.parts or max(self.rank.get(a, -1), self.rank.get(b, -1)) > n:
                raise ValueError("every entry must come from one merge of earlier entries")
            self.rank[made], self.parts[made], self.merge[a, b] = n, (a, b), n
        self._known: dict[int, bool] = {}
        self.single = {s: i for i, s in self.symbols.items() if len(s) == 1}
        self.length = {i: len(s) for i, s in self.symbols.items()}
        self.automaton = ahocorasick.Automaton()
        reachable: dict[int, bool] = {i: True for i in self.symbols if i not in self.parts}
        for i in sorted(self.parts, key=self.rank.__getitem__):
            a, b = self.parts[i]
            reachable[i] = reachable[a] and reachable[b] and self._stays(a, b, self.rank[i])
        for i, s in self.symbols.items():
            if reachable[i] and len(s) > 1:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def _symbol(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + self.END)
        return token

    def _stays(self, left: int, right: int, until: int | None = None) -> bool:
        """Whether no merge joins the touching ends of two entries while they are built up (before rank ``until``).

        The parts at the border change only when the left entry's right end or
        the right entry's left end is merged into a larger part. A pair that
        touches in between is joined if its rank comes before both changes;
        among equal ranks the leftmost place goes first.
        """
        ends, starts = [left], [right]
        while ends[-1] in self.parts:
            ends.append(self.parts[ends[-1]][1])
        while starts[-1] in self.parts:
            starts.append(self.parts[starts[-1]][0])
        never = 1 << 60
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            up_left = self.rank[ends[i - 1]] if i else never
            up_right = self.rank[starts[j - 1]] if j else never
            joined = self.merge.get((ends[i], starts[j]), never)
            if joined < up_left and joined <= up_right and joined < never:
                return joined == until and not i and not j
            if up_left == never and up_right == never:
                return until is None
            if up_left <= up_right:
                i -= 1
            else:
                j -= 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two entries, one after the other, are the encoding of their joint text."""
        if len(self._known) > 400_000:
            self._known.clear()
        fits = self._known[(left << 20) | right] = self._stays(left, right)
        return fits

    def word(self, characters: str) -> list[int]:
        """Ids of one word, given as byte characters."""
        if not characters:
            return []
        if self.suffix:
            characters = characters[:-1] + chr(ord(characters[-1]) + self.END)
        # an entry of one symbol is last where no longer one fits
        last = list(map(self.single.__getitem__, characters))
        length, known, settled = self.length, self._known, -1
        for end, token in self.automaton.iter(characters):
            if end != settled:
                before = end - length[token]
                if before < 0:
                    last[end], settled = token, end
                else:
                    fits = known.get((last[before] << 20) | token)
                    if fits is None:
                        fits = self.compatible(last[before], token)
                    if fits:
                        last[end], settled = token, end
        ids, at = [], len(characters) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids


class Pieces(dict):
    """Ids of pieces between blanks and of words, as packed integers, in two generations of bounded size."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoder.piece_ids(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = self.copy()
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids and back, as the tokenizer of the file does without its special tokens' additions."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if not self.vocabulary.suffix or WORD not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") or spec["decoder"]:
            raise ValueError("only the tokenizer with word ends is supported")
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.hints = tuple({n[:2] for n in names})
        self.words = regex.compile(WORD)
        self.bytes = byte_characters()
        self.tokens = [self.vocabulary.tokens.get(i, "") for i in range(max(self.vocabulary.tokens) + 1)]
        #: packed form of ids: two bytes each if the vocabulary allows
        self.code, self.packed = ("H", np.uint16) if len(self.tokens) <= 1 << 16 else ("I", np.uint32)
        self.pieces = Pieces(self)

    def piece_ids(self, piece: str) -> bytes:
        words = [piece] if piece.isalpha() else self.words.findall(piece)
        if len(words) == 1 and words[0] == piece:
            letters = piece if piece.isascii() else "".join([self.bytes[b] for b in piece.encode()])
            return array(self.code, self.vocabulary.word(letters)).tobytes()
        return b"".join([self.pieces[w] for w in words])

    def decode(self, ids: np.ndarray) -> str:
        """The tokenizer file has no decoder: entries are joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def _plain(self, text: str) -> list[bytes]:
        if USUAL_TEXT.fullmatch(text):
            return list(map(self.pieces.__getitem__, text.lower().split()))
        text = self.tokenizer.normalizer.normalize_str(text)
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [array(self.code, self.vocabulary.word(w)).tobytes() for w, _ in words]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (None: empty)."""
        if not text:
            return np.empty(0, self.packed)
        if self.special is None or not any(h in text for h in self.hints):
            return np.frombuffer(b"".join(self._plain(text)), self.packed)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(array(self.code, [self.vocabulary.special[found[0]]]).tobytes())
            at = found.end()
        return np.frombuffer(b"".join(out + self._plain(text[at:])), self.packed)


class LibraryEncoder:
    """Ids of many whole texts by the tokenizers library, which gets each word once while the cache has it.

    Texts are cut at blanks and looked up a step at a time: Arrow finds the
    different pieces of a step, the cache is asked once for each, and words
    that it lacks go to the model of the file, many in one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix")
        self.bytes = byte_characters()
        if not suffix or WORD not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError("only the tokenizer with word ends is supported")
        if any(c not in vocab or c + suffix not in vocab for c in self.bytes):
            raise ValueError("every byte must have an entry inside and at the end of words")
        added = spec["added_tokens"]
        if any(a.get(k) for a in added for k in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError("only literal added tokens are supported")
        self.special = {a["content"]: a["id"] for a in added}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.hints = tuple({n[:2] for n in self.special})
        #: ids are below this
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.packed = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # the same model on words that are cut already
        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(spec | bare | {"truncation": None, "padding": None}))
        self.letters = {b: c for b, c in enumerate(self.bytes)}
        self.words = regex.compile(WORD)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _keep(self, ids: dict[str, bytes]) -> None:
        """Into the cache, two generations of bounded size."""
        short = {piece: packed for piece, packed in ids.items() if len(piece) <= CACHE_CHARS}
        if len(self.ids) + len(short) <= CACHE_ENTRIES:
            self.ids.update(short)
        else:
            for piece, packed in short.items():
                if len(self.ids) >= CACHE_ENTRIES:
                    self.older, self.ids = self.ids, {}
                self.ids[piece] = packed

    def _encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of different words, from the library."""
        made: dict[str, bytes] = {}

        def call() -> None:
            text = " ".join([w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in held])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.packed)
            # each word ends with the only one of its ids that has the suffix
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.packed.itemsize).tolist()
            flat = ids.tobytes()
            made.update(zip(held, [flat[a:b] for a, b in zip([0, *ends], ends)], strict=True))

        held, size = [], 0
        for word in words:
            held.append(word)
            size += len(word)
            if size >= CALL_CHARS:
                call()
                held, size = [], 0
        if held:
            call()
        return made

    def _cut(self, piece: str) -> list[str]:
        """The words of a piece between blanks, as the tokenizer normalises and cuts it."""
        if USUAL_TEXT.fullmatch(piece):
            piece = piece.lower()
            return [piece] if piece.isalpha() else self.words.findall(piece)
        text = self.tokenizer.normalizer.normalize_str(piece)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece."""
        get, older = self.ids.get, self.older.get
        found = list(map(get, pieces))
        missing = dict.fromkeys([p for p, ids in zip(pieces, found) if ids is None])
        if not missing:
            return found
        again = {p: ids for p in missing if (ids := older(p)) is not None}
        parts = {p: self._cut(p) for p in missing if p not in again}
        words = dict.fromkeys([w for ws in parts.values() for w in ws])
        made = {w: ids for w in words if (ids := get(w) or older(w))}
        made |= self._encode_words([w for w in words if w not in made])
        new = {p: made[ws[0]] if len(ws) == 1 else b"".join([made[w] for w in ws]) for p, ws in parts.items()} | again
        self._keep(made | new)
        return [new[p] if ids is None else ids for p, ids in zip(pieces, found)]

    def _alone(self, text: str) -> np.ndarray:
        """Ids of a text that holds special strings or unusual code points."""
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += [*self.lookup(BLANKS.split(text[at : found.start()])), np.array(self.special[found[0]], self.packed).tobytes()]
            at = found.end()
        return np.frombuffer(b"".join([*out, *self.lookup(BLANKS.split(text[at:]))]), self.packed)

    def _step(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [USUAL_TEXT.fullmatch(t) is not None and not any(h in t for h in self.hints) for t in texts]
        cut = pc.utf8_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(texts, plain)], pa.large_string()))
        coded = pc.dictionary_encode(cut.values)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = self.lookup(pieces)
        ends = np.cumsum([0, *map(len, each)]) // self.packed.itemsize
        lists = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(each), self.packed)).take(coded.indices)
        ids = lists.values.to_numpy()
        # from pieces to texts
        bounds = lists.offsets.to_numpy()[cut.offsets.to_numpy()].tolist()
        for text, p, a, b in zip(texts, plain, bounds, bounds[1:]):
            yield ids[a:b] if p else self._alone(text)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each whole text in turn (None: empty), as the library gives them for the file."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= STEP_CHARS:
                yield from self._step(held)
                held, size = [], 0
        if held:
            yield from self._step(held)


def encoder(path: str) -> Encoder:
    """The encoder of a file, once per worker."""
    return worker_table(__name__, path, Encoder)


def id_lists(each: list[np.ndarray]) -> pa.Array:
    """Lists of 32-bit ids."""
    ends = np.cumsum([0, *map(len, each)])
    flat = np.concatenate(each) if each else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of every whole text and the text decoded from them.

    A null or empty text gives an empty list and an empty text. Equal rows give
    equal results. Other columns stay, but for those with the names of the added ones.
    Ids equal those of the tokenizers library for the same file.
    """

    def run(texts: list[str | None]) -> list[pa.Array]:
        tokenizer = encoder(path)
        each = [tokenizer.encode(t) for t in texts]
        return [id_lists(each), pa.array([tokenizer.decode(i) for i in each], pa.string())]

    return over_texts(df, text, run, [StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])
