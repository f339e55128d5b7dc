"""Texts to ids with the tokenizers library, each distinct word once for a batch, and recent words not at all.

Both known vocabularies split a text before their merges, and never across a run of white space that a word follows. So a
text's ids are those of its words, one after the other. The words of a batch are counted and numbered by Arrow, only distinct
ones are looked up in a bounded memory of recent words, and what is missing there is split into parts, whose merges the library's
model does without its own split. Texts where this doesn't hold for sure (unusual white space, the vocabulary's special
strings) go through the library whole, and so does every text of a vocabulary that splits in another way.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that every library normalises, classes and splits alike; blanks and line feeds are the only white space of them.
_SAFE = np.zeros(1 << 16, bool)
for _first, _last in ((10, 10), (32, 126), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x4E00, 0x9F9F), (0x410, 0x44F)):
    _SAFE[_first : _last + 1] = True
_PLAIN = re.compile(r"[ \n]?[!-~À-ÖØ-öø-ÿ]{1,64}").fullmatch
#: The splits of the two vocabularies, for words without inner white space.
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a generation of the memory holds; there are two generations.
REMEMBERED = 150_000
#: Characters of a batch of texts, and parts that go through the library as one text.
BATCH = 1 << 22
LINE = 1000
#: Ids are below 2 ** 24, so this isn't found across two ids.
_CUT = b"\xff" * 4
#: A word that is to be taken as it is, without the blank that other words have before them; a blank within it.
_AS_IS, _BLANK = "\r", "\x1e"


def _byte_characters() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, "<u2")
    table[own] = own
    rest = np.flatnonzero(table == 0)
    table[rest] = 256 + np.arange(rest.size)
    table[ord("\r")] = ord(" ")
    return table


class Memory:
    """The bytes of recent keys: a young generation becomes the old one when it is full, and the old one is forgotten."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, keys))
        missed = [i for i, x in enumerate(found) if x is None]
        asked = [keys[i] for i in missed]
        for i, k, x in zip(missed, asked, map(self.old.get, asked), strict=True):
            if x is not None:
                found[i] = self.young[k] = x
        return found

    def put(self, keys: list[str], values: list[bytes]) -> None:
        for at in range(0, len(keys), self.size):
            if len(self.young) >= self.size:
                self.young, self.old = {}, self.young
            self.young.update(zip(keys[at : at + self.size], values[at : at + self.size], strict=True))


class Encoder:
    """ids(texts): an array of ids (unsigned 32 bits) for each text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before, normal = said["pre_tokenizer"] or {}, said["normalizer"] or {}
        regexes = [p.get("pattern", {}).get("Regex") for p in before.get("pretokenizers", [])]
        #: Whether blanks belong to the word after them, None: a vocabulary that isn't known here.
        self.spaced = None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            self.spaced = True
        elif regexes == [_WORD_SPLIT, None] and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.spaced = False
        self.split = regex.compile(r"\r|" + (_BYTE_SPLIT if self.spaced else _WORD_SPLIT)).findall
        #: The same model behind a split at white space only, for parts in byte-level characters.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.characters = _byte_characters()
        self.long = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.long[i] = len(token if self.spaced else token.removesuffix("</w>"))
        self.words = Memory(REMEMBERED)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _taken_apart(self, text: str) -> str | None:
        """The text's words, joined by blanks; None: not to be taken apart."""
        if self.spaced is None or "<|" in text or not _SAFE[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")].all():
            return None
        if not self.spaced:
            return text.replace("\n", " ").lower()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            words = re.findall(r"(?:(?<=\S)|^)[ \n]*\S+|[ \n]+", text)
            return " ".join(w[1:] if w[0] == " " and " " not in w[1:] and len(w) > 1 else _AS_IS + w.replace(" ", _BLANK) for w in words)
        return _AS_IS + text.replace("\n", f" {_AS_IS}\n")

    def _merged(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, of many parts as one text that only white space splits. The lengths of the tokens tell where a part ends."""
        out = []
        for at in range(0, len(parts), LINE * 32):
            some = [parts[i : i + LINE] for i in range(at, min(at + LINE * 32, len(parts)), LINE)]
            mapped = [self.characters[np.frombuffer(("\r".join(x) + "\r").encode(), np.uint8)] for x in some]
            lines = [x.tobytes().decode("utf-16-le") for x in mapped]
            for x, e in zip(mapped, self.merges.encode_batch_fast(lines, add_special_tokens=False), strict=True):
                ids = array("I", e.ids)
                blanks = np.flatnonzero(x == 32)
                places = blanks - np.arange(blanks.size)
                raw = ids.tobytes()
                ends = (4 * np.searchsorted(self.long[np.frombuffer(ids, np.uint32)].cumsum(), places) + 4).tolist()
                out += [raw[i:j] for i, j in zip([0, *ends], ends)]
                if (ends[-1] if ends else 0) != len(raw):
                    raise ValueError("tokens and parts differ in length")
        return out

    def _key(self, part: str) -> str:
        """A part as a word of the memory."""
        if not self.spaced:
            return part
        return part[1:] if part[0] == " " and len(part) > 1 else _AS_IS + part

    def _form(self, key: str) -> str:
        """What the word stands for."""
        if not self.spaced:
            return key
        return key[1:].replace(_BLANK, " ") if key[:1] == _AS_IS else " " + key

    def _ids_of(self, keys: list[str]) -> list[bytes]:
        found = self.words.get(keys)
        missed = [i for i, ids in enumerate(found) if ids is None]
        if not missed:
            return found
        single, plain, odd = [], {}, []
        for i in missed:
            k = keys[i]
            if k.isalpha():
                single.append(k)
            elif _PLAIN(w := self._form(k)):
                plain[k] = w
            else:
                odd.append(k)
        flat = self.split("\r".join(plain.values())) if plain else []
        parts = {p: self._key(p) for p in dict.fromkeys(flat) if p != "\r"}
        got = dict(zip(parts.values(), self.words.get(list(parts.values())), strict=True))
        new = list(dict.fromkeys(chain(single, (k for k, ids in got.items() if ids is None))))
        merged = self._merged([" " + k if k.isalpha() else self._form(k) for k in new] if self.spaced else new)
        self.words.put(new, merged)
        got.update(zip(new, merged, strict=True))
        if flat:
            each = {p: got[k] for p, k in parts.items()} | {"\r": _CUT}
            whole = b"".join(map(each.__getitem__, flat)).split(_CUT)
            self.words.put(list(plain), whole)
            got.update(zip(plain, whole, strict=True))
        if odd:
            got.update(zip(odd, self._whole([self._form(k) for k in odd]), strict=True))
        for i in missed:
            found[i] = got[keys[i]]
        return found

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        taken = [self._taken_apart(t) if t else None for t in texts]
        apart = [s for s in taken if s is not None]
        n = np.array([s.count(" ") + 1 for s in apart], np.int64)
        out: list[np.ndarray] = []
        if apart:
            words = pc.split_pattern(pa.array([" ".join(apart)], pa.large_string()), " ").values.dictionary_encode()
            at = words.indices.to_numpy()
            distinct = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary.cast(pa.string()))
            found = self._ids_of(pc.binary_join(distinct, " ")[0].as_py().split(" "))
            sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            starts, each = np.cumsum(sizes) - sizes, sizes[at]
            ends = np.cumsum(each)
            ids = np.frombuffer(b"".join(found), np.uint32)[np.arange(ends[-1] if ends.size else 0) + np.repeat(starts[at] - ends + each, each)]
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        k = 0
        for t, s in zip(texts, taken, strict=True):
            if s is not None:
                out.append(ids[cuts[k] : cuts[k + 1]])
                k += 1
            else:
                out.append(np.frombuffer(self._whole([t])[0] if t else b"", np.uint32))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= BATCH:
                out += self._batch(held)
                held, size = [], 0
        return out + self._batch(held) if held else out


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    """The encoder of a file of the public tokenizers; a Python worker keeps the last one."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(name))
