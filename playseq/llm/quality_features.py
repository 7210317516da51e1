"""Counts that the quality rules look at, for all texts of a slice at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from playseq.llm.text import BYTES, NON_SPACE, WORDS, Words, covered, flat, mix, per_text

REPEAT_WINDOW = 8

# The characters that count as symbols and the marks that end a sentence.
SYMBOLS = "#*$%&|<>"
ENDS = ".!?"

FEATURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_ends",
    "n_shouts",
    "n_upper",
    "n_ascii_letters",
    "n_learned",
)

#: Word beginnings of these lengths (in bytes) and how often a text must hold them: what a lexicon is learned from.
PREFIXES = (4, 5, 6, 7, 8, 10, 12)
LEVELS = (1, 2, 3, 5)


def _table(characters: str) -> np.ndarray:
    member = np.zeros(256, bool)
    member[[ord(c) for c in characters]] = True
    return member


_SYMBOL, _END = _table(SYMBOLS), _table(ENDS)
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[ord("a") : ord("z") + 1] = True


def _in_text(hashes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Hashes that only agree within one text."""
    return mix(hashes + document.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _repeats(words: Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """Words inside windows that the text holds twice or more."""
    if len(hashes) < window:
        return np.zeros(len(hashes), bool)
    start = np.flatnonzero(words.room() >= window)
    content = WORDS.windows(WORDS.prefix(hashes), window)[start]
    content = _in_text(content, words.document[start])
    _, which, times = np.unique(content, return_inverse=True, return_counts=True)
    return covered(start[times[which] > 1], window, len(hashes))


def _repeated_lines(data: np.ndarray, at: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them that equal an earlier line."""
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    document = np.searchsorted(at, start, "right") - 1
    inside = (start < len(data)) & (document < len(at) - 1)
    # A line feed at the very end of a text opens an empty line, which holds no word.
    start, document = start[inside], document[inside]
    end = np.append(start[1:], len(data))
    end = np.minimum(end, at[document + 1])
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 0x0A))
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, document = start[has_word], end[has_word], document[has_word]
    content = _in_text(BYTES.between(BYTES.prefix(BYTES.table[data]), start, end), document)
    _, first = np.unique(content, return_index=True)
    later = np.ones(len(start), bool)
    later[first] = False
    n = len(at) - 1
    return np.bincount(document, minlength=n), np.bincount(document[later], minlength=n)


def plain_words(data: np.ndarray, at: np.ndarray) -> Words:
    """Words in lower case without digits or marks, as word lists are looked up."""
    letters = np.zeros(256, bool)
    letters[ord("a") : ord("z") + 1] = True
    letters[0x80:] = True
    return Words(data, at, letters, lower=True)


#: An entry of a lexicon: words that begin with so many bytes (0: whole words) of this hash, so often in a text.
ENTRY = np.dtype([("size", np.int32), ("level", np.int32), ("hash", np.uint64)])


def _of_size(plain: Words, prefix: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words and hashes of beginnings of one size; 0: of whole words."""
    end = plain.start + size if size else plain.end
    long = np.flatnonzero(end <= plain.end)
    return long, BYTES.between(prefix, plain.start[long], end[long])


def beginnings(plain: Words) -> tuple[np.ndarray, np.ndarray]:
    """Every entry that a text matches, once for each text: the text, and the entry."""
    prefix = BYTES.prefix(BYTES.table[plain.data])
    texts, entries = [], []
    for size in (*PREFIXES, 0):
        word, key = _of_size(plain, prefix, size)
        text = plain.document[word]
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[: len(key)])
        times = np.diff(np.append(first, len(key)))
        for level in LEVELS:
            reached = first[times >= level]
            found = np.empty(len(reached), ENTRY)
            found["size"], found["level"], found["hash"] = size, level, key[reached]
            texts.append(text[reached])
            entries.append(found)
    return np.concatenate(texts), np.concatenate(entries)


def matches(plain: Words, lexicon: np.ndarray) -> np.ndarray:
    """How many words of each text belong to entries of the lexicon that it matches."""
    n = len(plain.first) - 1
    telling = np.zeros(len(plain.start), bool)
    prefix = BYTES.prefix(BYTES.table[plain.data])
    for size in np.unique(lexicon["size"]):
        word, key = _of_size(plain, prefix, size)
        for entry in lexicon[lexicon["size"] == size]:
            found = word[key == entry["hash"]]
            text = plain.document[found]
            telling[found[np.bincount(text, minlength=n)[text] >= entry["level"]]] = True
    return np.bincount(plain.document[telling], minlength=n)


def measure(
    texts: pa.Array, repeat_window: int = REPEAT_WINDOW, lexicon: np.ndarray | None = None
) -> dict[str, np.ndarray]:
    """Every feature of every text; a null text counts as empty. `lexicon`: an array of ENTRY."""
    data, at = flat(texts)
    words = Words(data, at, NON_SPACE)
    n_lines, n_dup_lines = _repeated_lines(data, at, words)
    hashes = words.hashes()
    last = data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    text = words.document

    n = len(at) - 1
    n_learned = np.zeros(n, np.int64)
    if lexicon is not None and len(lexicon):
        n_learned = matches(plain_words(data, at), lexicon)
    return {
        "n_words": words.counts,
        "word_chars": per_text(NON_SPACE[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": per_text(_SYMBOL[data], at),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": per_text(_repeats(words, hashes, repeat_window), words.first),
        "n_lines": n_lines,
        "n_ends": np.bincount(text[_END[last]], minlength=n),
        "n_shouts": np.bincount(text[last == ord("!")], minlength=n),
        "n_upper": per_text(_UPPER[data], at),
        "n_ascii_letters": per_text(_ASCII_LETTER[data], at),
        "n_learned": n_learned,
    }


