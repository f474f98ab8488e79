"""Token ids of whole texts with a ``tokenizers`` vocabulary file.

Encoding word by word and remembering words gives the ids of the whole text, because both supported
pre-tokenizers always cut at a single space between two other characters (``byte`` puts the space
in front of the word, ``word`` drops it). Nothing is cut anywhere else.
"""

from __future__ import annotations

import itertools
import os
import re
import string
import struct
import threading

import numpy as np

# Words remembered per Python worker and generation; two generations are kept.
REMEMBERED = 300_000
# Text whose distinct words are looked up together; what is held meanwhile is some ten times as large.
TOGETHER_BYTES = 8 << 20

_SPACE_RUN = re.compile(r"\s ")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
# Latin letters, then ASCII punctuation: a pre-token each. The dotted capital I is left out because
# its lower case is not one letter.
_LETTERS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
_LETTERS_MARKS = re.compile(rf"({_LETTERS})([!-/:-@\[-`{{-~]*)")
# How byte-level vocabularies write the bytes of a text: printable ones as themselves.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_AS_TEXT = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}


# Single marks that often end a word; a word of none is not among them.
_ENDINGS = frozenset(".,;:!?")
_STRUCTS = [struct.Struct(f"<{n}I") for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _STRUCTS[len(ids)].pack(*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Word -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, library, prefix: str, lower: bool, remembered: int):
        super().__init__()
        self.remembered = remembered
        self.library, self.prefix, self.lower, self.old = library, prefix, lower, {}
        self.tokenize = library.model.tokenize
        self.prefix_as_text = "".join(map(_AS_TEXT.__getitem__, prefix.encode()))
        # a line end between two words is a cut: a token of its own or nothing
        self.newline, self.behind_newline = self.whole("\n"), self

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def one_pretoken(self, word: str) -> bytes:
        """Straight to the model, past the normalizer and the pre-tokenizer."""
        as_text = word if word.isascii() else "".join(map(_AS_TEXT.__getitem__, word.encode()))
        return _packed([t.id for t in self.tokenize(self.prefix_as_text + as_text)])

    def letters(self, word: str) -> bytes:
        lowered = word.lower() if self.lower else word
        return self.one_pretoken(word) if lowered == word else self[lowered]

    def fresh(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.letters(word)
        if "\n" in word:
            before, _, after = word.partition("\n")
            if before and after and not before[-1].isspace() and not after[0].isspace():
                return self[before] + self.newline + self.behind_newline[after]
        parts = _LETTERS_MARKS.fullmatch(word)
        if not parts:
            return self.whole(self.prefix + word)
        return self[parts[1]] + self.marks(parts[2]) if parts[2] else self.letters(word)

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            # most new words are lower-case ASCII letters, or such with one mark behind them
            if word.isalpha() and word.isascii() and (word.islower() or not self.lower):
                got = _packed([t.id for t in self.tokenize(self.prefix_as_text + word)])
            elif word[-1:] in _ENDINGS and word[:-1].isalpha() and word.isascii():
                got = self[word[:-1]] + self.marks(word[-1])
            else:
                got = self.fresh(word)
                if "\n" in word:
                    return got  # two words that rarely meet again; each of them is remembered
        if len(self) >= self.remembered:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def marks(self, text: str) -> bytes:
        key = "\0" + text  # apart from the same marks as a word of their own
        got = self.get(key)
        if got is None:
            got = self[key] = self.whole(text)
        return got


class _Column:
    """Ids of whole columns, for vocabularies that drop the space before a word.

    The distinct words of some texts are looked up together. Words are remembered without case and
    the ASCII marks behind them, as Arrow arrays: some 30 bytes a word.
    """

    def __init__(self, words: _Words):
        import pyarrow as pa

        self.words, self.most = words, 2 * words.remembered
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.used = np.zeros(0, dtype=bool)

    def _remember(self, words, ids):
        import pyarrow as pa

        self.known, self.ids = pa.concat_arrays([self.known, words]), pa.concat_arrays([self.ids, ids])
        self.used = np.append(self.used, np.ones(len(words), dtype=bool))

    def _forget(self):
        """Above the bound, keeps the last half of it of what was asked for since the last time."""
        import pyarrow as pa

        if len(self.known) > self.most:
            kept = pa.array(np.flatnonzero(self.used)[-(self.most // 2) :])
            self.known, self.ids = self.known.take(kept), self.ids.take(kept)
            self.used = np.zeros(len(kept), dtype=bool)

    def _fresh(self, word: str, letters: bool) -> bytes:
        return self.words.one_pretoken(word.lower()) if letters else self.words.whole(word)

    def _stems(self, stems, letters: np.ndarray):
        """Ids of distinct stems, which are letters alone or any words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(stems, value_set=self.known)
        new, first = pc.is_null(at), len(self.known)
        asked = stems.filter(new)
        some = letters[new.to_numpy(zero_copy_only=False)].tolist()
        self._remember(asked, pa.array(list(map(self._fresh, asked.to_numpy(zero_copy_only=False).tolist(), some)), pa.large_binary()))
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        at[new.to_numpy(zero_copy_only=False)] = np.arange(first, len(self.known))
        self.used[at] = True
        return self.ids.take(pa.array(at))

    def __call__(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        # a line end cuts like a space, and neither joins with what is around it
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        stems = pc.utf8_rtrim(distinct, characters=string.punctuation)
        letters = pc.match_substring_regex(stems, f"^{_LETTERS}$")
        stems = pc.if_else(letters, pc.ascii_lower(stems), distinct)
        # the marks behind letters, each string of them once; place 0: none
        size = pc.binary_length(stems)
        marked = np.flatnonzero(pc.greater(pc.binary_length(distinct), size).to_numpy(zero_copy_only=False))
        cut = pc.utf8_length(stems).to_numpy()[marked].tolist()
        marks = pa.array([w[n:] for w, n in zip(distinct.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist(), cut)], pa.string()).dictionary_encode()
        ids_of_marks = pa.array([b"", *map(self.words.whole, marks.dictionary.to_pylist())], pa.large_binary())
        mark = np.zeros(len(distinct), dtype=np.int64)
        mark[marked] = marks.indices.to_numpy() + 1

        stems = stems.dictionary_encode()
        is_letters = np.zeros(len(stems.dictionary), dtype=bool)
        is_letters[stems.indices.to_numpy()] = letters.to_numpy(zero_copy_only=False)
        ids_of = self._stems(stems.dictionary, is_letters).take(stems.indices)
        ids_of = pc.binary_join_element_wise(ids_of, ids_of_marks.take(pa.array(mark)), pa.scalar(b"", pa.large_binary()))
        self._forget()
        ids = ids_of.take(coded.indices)
        flat = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        # every text has a word, if only an empty one
        last = np.cumsum(pc.list_value_length(words).to_numpy())
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[last].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """``encode(text)`` gives ids as bytes. ``space_in_word`` tells the two pre-tokenizers apart."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True  # their strings are ordinary text
        self.space_in_word = library.normalizer is None
        lower = not self.space_in_word
        self.rest = _Words(library, " " if self.space_in_word else "", lower, remembered)
        self.first = _Words(library, "", lower, remembered) if self.space_in_word else self.rest
        self.rest.behind_newline = self.first
        self.column = None if self.space_in_word else _Column(self.rest)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.space_in_word:
            return b"".join(map(self.rest.__getitem__, text.split(" ")))
        words = _SINGLE_SPACE.split(text) if _SPACE_RUN.search(text) else text.split(" ")
        rest = map(self.rest.__getitem__, words[1:])
        return self.first[words[0]] + b"".join(rest)

    def encode_column(self, column):
        """``encode`` of each value of an Arrow string column in turn, null as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.string()), "")
        # texts are taken together until they pass a border
        border = np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64) // TOGETHER_BYTES
        cuts = (np.flatnonzero(np.diff(border)) + 1).tolist()
        for a, b in itertools.pairwise([0, *cuts, len(column)]):
            some = column.slice(a, b - a)
            if len(some):
                yield from self.column(some) if self.column else map(self.encode, some.to_pylist())


_LOADED = threading.local()


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per Python worker, file and word memory, kept between tasks."""
    known = _LOADED.__dict__.setdefault("by_path", {})
    if (path, remembered) not in known:
        known[path, remembered] = Encoder(path, remembered)
    return known[path, remembered]


def public_path(name: str) -> str:
    """Place of a public vocabulary file; the default of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path(name)
