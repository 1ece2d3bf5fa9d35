"""Token ids of whole texts, by the tokenizers library, with the ids of common words kept between texts.

Both supported tokenizers split a text before they merge, and never merge over a split. Where a text is made
of known characters only, it can be cut at those splits beforehand (single blanks and line feeds between
visible characters), and each distinct part encoded once. Any other text is encoded whole, and so is one that holds an
added token such as <|endoftext|>, which gives that token's own id, as the library does.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, texts_of

_UNKNOWN = re.compile("[^\n -~¡-˿Ͱ-ᙿ]")
_PLAIN_PART = re.compile(" ?[!-~¡-˿Ͱ-ᙿ]+|\n")
#: Parts encoded in one call.
_TOGETHER = 64
#: Texts that aren't cut at single blanks and line feeds; RE2, as Arrow matches it.
_NOT_CUT = r"[^\n -~\x{A1}-\x{2FF}\x{370}-\x{167F}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: Behind a letter these are one word of their own to the byte style's tokenizer, as many as follow each other.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of texts that are cut at once, or one text; in the word style, texts.
_SLICE, _TEXTS = 4 << 20, 64


class CachedEncoder:
    """Little-endian unsigned 32-bit ids of texts.

    style "byte": byte-level BPE whose words carry the blank before them; "word": BPE with word ends, white space dropped.
    max_parts bounds the kept parts, and with them the memory. Columns are encoded with two tables of a quarter as many parts, and a
    slice's new ones: when the first is full it becomes the second, whose parts are taken over where they occur again.
    """

    def __init__(self, path: str, style: str, max_parts: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.style, self.max_parts, self.known, self.older = style, max_parts, {}, {}
        self.ends = {c: self._ids([c])[0].tobytes() for c in ",."}
        if style == "byte":
            blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
            self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(blank)]] = True
        else:
            self.mark = self.tokenizer.encode("0", add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str] | None:
        """The text's parts, encoded apart; None: the text has to be encoded whole."""
        if _UNKNOWN.search(text) or any(t in text for t in self.added):
            return None
        if self.style == "word":
            return text.split()
        if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return None
        return text.replace("\n", " \0\n\0").replace(" ", "\0 ").replace("\0 \0", "\0").split("\0")

    def _learn(self, new: set[str]) -> None:
        """Keeps the ids of new parts. A comma or full stop behind a letter is a word of its own to both tokenizers."""
        known = self.known
        ended = [p for p in new if p[-1] in ",." and p[-2:-1].isalpha()]
        new.difference_update(ended)
        new.update(p[:-1] for p in ended)
        self._call(list(new.difference(known)))
        known.update((p, known[p[:-1]] + self.ends[p[-1]]) for p in ended)

    def _call(self, new: list[str]) -> None:
        """Encodes parts, many in one call where it can be told from the ids where each begins.

        Byte style: each part begins with a blank and has no other. Word style: a part that is "0" stands between two.
        """
        byte = self.style == "byte"
        joint = [p for p in new if (p[0] == " " if byte else "0" not in p)]
        alone = [p for p in new if not (p[0] == " " if byte else "0" not in p)]
        self.known.update((p, x.tobytes()) for p, x in zip(alone, self._ids(alone), strict=True))
        groups = [joint[k : k + _TOGETHER] for k in range(0, len(joint), _TOGETHER)]
        step = _TOGETHER if byte else max(1, len(groups))
        calls = (self._ids([("" if byte else " 0 ").join(g) for g in groups[k : k + step]]) for k in range(0, len(groups), step))
        for group, ids in zip(groups, chain.from_iterable(calls), strict=True):
            if byte:
                at = np.append(np.flatnonzero(self.opens[ids]), len(ids))
                ends, starts = at[1:], at[:-1]
            else:
                at = np.flatnonzero(ids == self.mark[0])
                ends, starts = np.append(at, len(ids)), np.append(0, at + 1)
            if len(starts) != len(group):
                raise ValueError("the ids don't show where parts begin")
            raw = ids.tobytes()
            self.known.update((p, raw[4 * i : 4 * j]) for p, i, j in zip(group, starts.tolist(), ends.tolist(), strict=True))

    def trim(self) -> None:
        """Keeps the memory bounded; to be called between texts."""
        if len(self.known) > self.max_parts:
            self.known.clear()

    def learn(self, parts: set[str]) -> None:
        """Makes sure that the ids of all parts are known, of whatever characters they are."""
        new = parts.difference(self.known)
        odd = [p for p in new if not _PLAIN_PART.fullmatch(p)]
        self.known.update((p, x.tobytes()) for p, x in zip(odd, self._ids(odd), strict=True))
        self._learn(new.difference(odd))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """As encode, of a column of strings; null counts as empty. In the byte style Arrow cuts the texts, and only a slice's distinct parts are looked up."""
        if self.style != "byte":
            return self.encode(texts_of(column))
        texts, out = pc.fill_null(column.cast(pa.large_string()), ""), []
        slices = np.cumsum(pc.binary_length(texts).to_numpy()) // _SLICE
        bounds = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(texts)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if len(self.known) > self.max_parts // 4:
                self.known, self.older = self.older, self.known
                self.known.clear()
            out += self._encode_slice(texts.slice(a, b - a))
        return out

    def _encode_slice(self, texts: pa.Array) -> list[bytes]:
        whole = pc.match_substring_regex(texts, "|".join([_NOT_CUT, *map(re.escape, self.added)]))
        # a carriage return, which no such text holds, stands before the first part, which has no blank; line feeds begin parts
        cut = pc.replace_substring(texts.filter(pc.invert(whole)), "\n", " \n")
        cut = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), cut, pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(cut, " ")
        firsts, parts = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        del cut
        joined = pa.array(self._ids_of(parts.dictionary), pa.large_binary()).take(parts.indices)
        del parts
        at = np.append(0, np.cumsum(pc.binary_length(joined).to_numpy()))[firsts].tolist()
        raw = memoryview(joined.buffers()[2] or b"")
        known = iter([raw[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])
        others = iter(self._ids(texts.filter(whole).to_pylist()))
        return [next(others).tobytes() if w else next(known) for w in whole.to_pylist()]

    def _ids_of(self, parts: pa.Array) -> list[bytes]:
        """Ids of parts of _encode_slice. They are kept by the part with a blank before it, also where it begins a text or a line."""
        if len(parts) == 0:
            return []
        known = self.known
        keys = (" " + pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), pa.scalar("\0 ", pa.large_string()))[0].as_py()).split("\0")
        new, made, bases, ends = {"\n"}, [], [], []
        for key in self._unknown(keys):
            word = key if key[1] > "\r" else key[2:]
            base = word.rstrip(_MARKS)
            if base != word and not ("A" <= base[-1:] < "ɐ" and base[-1].isalpha()):
                base = word
            new.add(base)
            if base != key:
                made.append(key)
                bases.append(base)
                ends.append(word[len(base) :])
        self._call(self._unknown(new.union(filter(None, ends))))
        for key, base, end in zip(made, bases, ends, strict=True):
            ids = known[base] + known[end] if end else known[base]
            known[key] = known["\n"] + ids if key[1] == "\n" else ids
        return list(map(known.__getitem__, keys))

    def _unknown(self, parts: Iterable[str]) -> list[str]:
        """Those without known ids, after those of before are taken over."""
        known = self.known
        new = [p for p in parts if p not in known]
        before = list(map(self.older.get, new))
        known.update((p, x) for p, x in zip(new, before, strict=True) if x is not None)
        return [p for p, x in zip(new, before, strict=True) if x is None]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.style == "byte":
            return self.encode_column(pa.array(texts, pa.large_string()))
        out, known = [], self.known
        for k in range(0, len(texts), _TEXTS):
            self.trim()
            some = texts[k : k + _TEXTS]
            cut = [self.parts(t) for t in some]
            self._learn(set().union(*(parts for parts in cut if parts)).difference(known))
            get = known.__getitem__
            out += [self._ids([t])[0].tobytes() if parts is None else b"".join(map(get, parts)) for t, parts in zip(some, cut, strict=True)]
        return out


_ENCODERS: dict[tuple[str, str], CachedEncoder] = {}
#: Parts kept in a worker; fewer where packing shares its workers with the pipeline's other stages.
_MOST = {"byte": 800_000, "word": 600_000}


def encoder(path: str, style: str) -> CachedEncoder:
    """The worker's own encoder, kept from task to task."""
    if (path, style) not in _ENCODERS:
        _ENCODERS[path, style] = CachedEncoder(path, style, _MOST[style])
        KEPT.extend([_ENCODERS[path, style].known, _ENCODERS[path, style].older])
    return _ENCODERS[path, style]
