"""Counts over whole texts, many documents at a time."""

from __future__ import annotations

import numpy as np

from .textblocks import IS_SPACE, U64, Words, joined, mix64

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What list items begin with, and cut lines end in.
LIST_MARKS, ELLIPSES = (b"-", b"*", "•".encode()), (b"...", "…".encode())
_NAMES = ("inner", "upper", "lower", "digit", "symbol", "exclaim", "stop", "comma", "bar", "blank", "newline", "other_space", "wide", "control", "punct", "quote")
_CLASS = np.full(256, _NAMES.index("punct"), np.int64)
_CLASS[:32] = _NAMES.index("control")
for _chars, _name in ((range(128, 192), "inner"), (range(192, 256), "wide"), (range(65, 91), "upper"), (range(97, 123), "lower"), (range(48, 58), "digit"), (map(ord, SYMBOLS), "symbol"), (b"!", "exclaim"), (b".", "stop"), (b",", "comma"), (b"|", "bar"), (b" ", "blank"), (b"\n", "newline"), (b"\t\x0b\x0c\r", "other_space"), (b"\"'", "quote")):
    _CLASS[list(_chars)] = _NAMES.index(_name)


def byte_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: how many bytes of each class; ``chars`` code points; ``word_chars`` of them in words."""
    n, width = len(texts), len(_NAMES)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = np.repeat(np.arange(n, dtype=np.int64) * width, [len(t) for t in texts])
    table = np.bincount(at + _CLASS[buf], minlength=n * width).reshape(n, width)
    out = dict(zip(_NAMES, table.T))
    out["chars"] = table.sum(1) - out["inner"]
    out["word_chars"] = out["chars"] - out["blank"] - out["newline"] - out["other_space"]
    out["symbol"] = out["symbol"] + out["bar"]
    return out


def word_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: words, words of at most 2 and at least 12 bytes, distinct words, and words in repeated 3-word windows."""
    words = Words(texts, lower=False)
    n, first = len(texts), words.first
    doc = np.repeat(np.arange(n), words.count)
    size = words.end - words.start

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return sums[first[1:]] - sums[first[:-1]]

    salt = mix64(doc.astype(U64) + U64(1))
    own = words.hash ^ salt
    order = np.argsort(own)
    fresh = np.ones(len(own), bool)
    fresh[order[1:]] = own[order[1:]] != own[order[:-1]]
    repeated = np.zeros(len(own), bool)
    inside = np.flatnonzero(np.arange(len(own)) + 2 < first[1:][doc]) if len(own) else np.empty(0, np.int64)
    if len(inside):
        window = words.shingles(3)[inside] ^ salt[inside]
        order = np.argsort(window)
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(window), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = inside[twice]
        for j in range(3):
            repeated[hit + j] = True
    return {"n_words": words.count, "short_words": per_text(size <= 2), "long_words": per_text(size >= 12), "distinct_words": per_text(fresh), "n_repeat_words": per_text(repeated)}


def line_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: lines with a word, those equal to an earlier line, and the longest line's bytes."""
    out = np.zeros((len(texts), 3), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        if lines:
            out[i] = len(lines), len(lines) - len(set(lines)), max(map(len, lines))
    return {"n_lines": out[:, 0], "n_dup_lines": out[:, 1], "longest_line": out[:, 2]}


_IS_LETTER = np.zeros(256, np.int64)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def letter_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: words, and those of them without an ASCII letter or a wider character."""
    buf, first, _ = joined(texts)
    edge = np.diff(np.concatenate([[0], (~IS_SPACE[buf]).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.concatenate([[0], np.cumsum(_IS_LETTER[buf])])
    without = np.concatenate([[0], np.cumsum(letters[end] == letters[start])])
    cut = np.append(np.searchsorted(start, first), len(start))
    return {"words": np.diff(cut), "letterless": without[cut[1:]] - without[cut[:-1]]}


def top_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: words, and how often its most frequent word stands there."""
    words = Words(texts, lower=False)
    doc = np.repeat(np.arange(len(texts)), words.count)
    own = words.hash ^ mix64(doc.astype(U64) + U64(1))
    order = np.argsort(own)
    edge = np.flatnonzero(np.append(True, own[order[1:]] != own[order[:-1]])) if len(own) else np.empty(0, np.int64)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc[order[edge]], np.diff(np.append(edge, len(own))))
    return {"words": words.count, "top": top}


def mark_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: lines with a word, those that begin with a list mark, and those that end in an ellipsis."""
    out = np.zeros((len(texts), 3), np.int64)
    for i, t in enumerate(texts):
        lines = [x for line in t.split(b"\n") if (x := line.strip())]
        out[i] = len(lines), sum(x.startswith(LIST_MARKS) for x in lines), sum(x.endswith(ELLIPSES) for x in lines)
    return {"lines": out[:, 0], "listed": out[:, 1], "cut_short": out[:, 2]}


GROUPS = {"bytes": byte_counts, "words": word_counts, "lines": line_counts, "letters": letter_counts, "top": top_counts, "marks": mark_counts}


class Measures:
    """Statistics of a batch of texts, made for the asked rows only and kept."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self._done: dict[str, tuple[np.ndarray, dict[str, np.ndarray]]] = {}

    def get(self, group: str, rows: np.ndarray) -> dict[str, np.ndarray]:
        done, held = self._done.get(group, (np.zeros(len(self.texts), bool), {}))
        new = rows[~done[rows]]
        if len(new):
            for name, values in GROUPS[group]([self.texts[i] for i in new.tolist()]).items():
                if name not in held:
                    held[name] = np.zeros(len(self.texts), np.int64)
                held[name][new] = values
            done[new] = True
        self._done[group] = done, held
        return {name: v[rows] for name, v in held.items()}
