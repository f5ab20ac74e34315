"""Cutting texts where no tokenizer piece can cross, for the token operators.

Both byte-level tokenizers first split a text by a pattern whose pieces are a
run of one character class with at most one space before it, or a run of white
space. No piece holds a character that is not white space followed by white
space, so a text may be cut wherever white space follows such a character, and
the tokens of the parts are the tokens of the whole. Scripts without spaces are
also cut between a letter and a mark of their own punctuation, which are of
different classes.
"""

from __future__ import annotations

import re

CUT = re.compile(r"(?<=\S)(?=\s)")
#: White space other than single spaces and line feeds: there the quick way below would cut wrongly.
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]")
#: Parts over this many characters are cut at marks too, and no cache keeps them.
LONG = 64
_MARKS = re.compile("(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[\u3001\u3002\u300c-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f])")


def segments(text: str) -> list[str]:
    """The parts of ``text``, in order; joined they are the text again."""
    if not text:
        return []
    if text[0] in " \n" or _ODD_SPACE.search(text):
        parts = CUT.split(text)
    else:
        first, *rest = text.replace("\n", " \n").split(" ")
        parts = [first, *[x if x[:1] == "\n" else " " + x for x in rest]]
    if max(map(len, parts)) > LONG:
        return [x for part in parts for x in (_MARKS.split(part) if len(part) > LONG else (part,))]
    return parts


def by_size(texts, most: int):
    """Lists of consecutive texts of about ``most`` characters each; a longer text stands alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > most:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def slices(batches, rows: int):
    """Arrow batches of at most ``rows`` rows, so that a worker holds little beside its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo(dict):
    """A cache of two generations of at most ``most`` entries each: a full one becomes the old one, whose entries come back when asked for.

    Misses go to ``make``. Keys longer than ``longest`` are made anew each time, so the cache has a bound in bytes too.
    """

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.most:
            self.put(key, made)
        else:
            self[key] = made
        return made

    def put(self, key, made) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = made
