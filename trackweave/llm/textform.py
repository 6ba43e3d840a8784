"""Subtitle texts brought to one plain form, vectorised over many documents: obfuscated, broken and decorated spellings meet."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from trackweave.llm.lexicon import ADDRESS_ENDINGS, DIGIT_LETTERS, LOOKALIKES, MEANINGS

SPACE, STAR, END = ord(" "), ord("*"), 3
#: Longest stage direction in brackets, speaker label before a colon, and mark-up tag, in characters.
LONGEST_BRACKET, LONGEST_LABEL, LONGEST_TAG = 80, 24, 40


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the plain form (0: drop) and whether it is an upper-case letter."""
    plain = np.full(0x20000, SPACE, np.uint8)
    upper = np.zeros(0x20000, bool)
    for point in [*range(0x3000), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        char = chr(point)
        kind = unicodedata.category(char)
        upper[point] = kind == "Lu"
        if kind in ("Mn", "Cf", "Me") or (kind == "Cc" and char not in "\n\r\t"):
            plain[point] = 0
            continue
        base = unicodedata.normalize("NFKD", char.lower())[:1].lower()
        if "a" <= base <= "z":
            plain[point] = ord(base)
    for char, letter in LOOKALIKES:
        for form in {char, char.upper()}:
            if len(form) == 1:
                plain[ord(form)] = ord(letter)
    for char, letter in DIGIT_LETTERS:
        plain[ord(char)] = ord(letter)
    for char in "*#%^~":
        plain[ord(char)] = STAR
    plain[0xFFFD] = STAR
    plain[END] = END
    return plain, upper


def fold(term: str) -> str:
    """The plain form of a word or phrase."""
    codes = _tables()[0][[ord(c) for c in term]]
    return " ".join(codes[codes != 0].tobytes().decode("latin-1").replace("l", "i").split())


#: UTF-8 of two to four bytes, each read as a Windows-1252 character.
_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]{1,3}")


def _reread(match: re.Match) -> str:
    raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in match[0])
    for size in range(len(raw), 1, -1):
        try:
            return raw[:size].decode("utf-8") + match[0][size:]
        except UnicodeError:
            pass
    return match[0]


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252, once or twice, read rightly; anything else as it is."""
    if text.isascii():
        return text
    once = _MISREAD.sub(_reread, text)
    return once if once == text else _MISREAD.sub(_reread, once)


#: Marks that end a sentence, if one of the others follows.
_STOPS, _AFTER_STOP = [ord(c) for c in ".!?\u2026"], [ord(c) for c in ' \n\r\t"\u00bb\u201d<']
#: A web address: a known beginning, or a name, a dot and a known ending.
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w-]{2,}\.(?:" + "|".join(ADDRESS_ENDINGS) + r")(?![\w-])", re.IGNORECASE)
#: A second person who is called something: the mark of speech beside an address or in brackets.
_SPOKEN_TO = re.compile(r"\b(?:" + "|".join(re.escape(w) for w in MEANINGS["you"] if len(w) > 1 and "*" not in w) + r")\s+(?:\w+\s+){0,2}?(?:" + "|".join(sorted(re.escape(w.rstrip("*")) for w in MEANINGS["insult"] + MEANINGS["beast"] + MEANINGS["demean"] if len(w) > 3)) + ")", re.IGNORECASE)


@dataclass
class Plain:
    """Plain texts, one after the other, each begun and ended by a space; starts has one entry more than texts, stops are the places where sentences end. The counts are per text."""

    text: str
    starts: np.ndarray
    stops: np.ndarray
    letters: np.ndarray
    upper: np.ndarray
    exclaims: np.ndarray
    stars: np.ndarray
    odd_letters: np.ndarray
    spaced: np.ndarray
    drawn_out: np.ndarray


def _spans(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True within any of the ranges [start, end)."""
    inside = np.zeros(size, bool)
    lengths = ends - starts
    if len(starts):
        inside[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = True
    return inside


def _pairs(points: np.ndarray, opening: int, closing: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges from an opening mark to the next closing one, if that is near."""
    at, to = np.nonzero(points == opening)[0], np.nonzero(points == closing)[0]
    if not len(at) or not len(to):
        return at[:0], at[:0]
    following = np.searchsorted(to, at)
    some = following < len(to)
    at, ends = at[some], to[following[some]] + 1
    near = ends - at <= longest
    return at[near], ends[near]


def plain_form(texts: list[str]) -> Plain:
    """Speech only: without cue numbers, timing lines, mark-up, stage directions in brackets or between asterisks, speaker labels and sentences with web addresses.

    Letters lose case and accents; look-alike letters of other scripts, digits and signs written for letters become the letter;
    invisible characters go; words broken over lines by a hyphen are joined; letters spaced apart make one word; a letter drawn out
    three times or more is written once. * stands for a masked letter. Everything else is one space.
    """
    table, is_upper = _tables()
    texts = [t.replace(chr(END), " ") if chr(END) in t else t for t in texts]
    joined = "".join(chr(END) + "\n" + repaired(t) + "\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(points, 0x1FFFF)
    codes = table[points]
    newline = points == 10
    size = len(points)

    line_ends = np.nonzero(newline)[0]
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    letter = (codes >= 97) & (codes <= 122)
    digit = (points >= 48) & (points <= 57)
    real = letter & ~digit
    real_before = np.concatenate([[0], np.cumsum(real, dtype=np.int32)])
    digit_before = np.concatenate([[0], np.cumsum(digit, dtype=np.int32)])
    arrows = np.nonzero((points[:-2] == 45) & (points[1:-1] == 45) & (points[2:] == 62))[0]
    timing = np.zeros(len(line_ends), bool)
    timing[np.searchsorted(line_ends, arrows)] = True
    width = line_ends - line_starts
    digits_in = digit_before[line_ends] - digit_before[line_starts]
    number = (digits_in > 0) & (width - digits_in <= 2) & (real_before[line_ends] == real_before[line_starts])
    header = timing | number

    # The sentence with a web address is an advert, within its line; so is its whole cue, unless somebody is called names in it.
    opens = np.zeros(len(line_ends), bool)
    opens[np.searchsorted(line_ends, np.nonzero(points == END)[0])] = True  # lines before a text's first timing line belong to no cue
    cue_of_line = np.cumsum(timing | opens)
    addresses = np.array([m.start() for m in _ADDRESS.finditer(joined)], np.int64)
    adverts = np.setdiff1d(cue_of_line[np.searchsorted(line_ends, addresses)], cue_of_line[opens])
    begin, finish = line_starts[np.searchsorted(cue_of_line, adverts)], line_ends[np.searchsorted(cue_of_line, adverts, side="right") - 1]
    adverts = adverts[[not _SPOKEN_TO.search(joined, a, b) for a, b in zip(begin, finish)]] if len(adverts) else adverts
    advert = np.isin(cue_of_line, adverts)
    drop_line = header | advert

    gone = _spans(size, line_starts[drop_line], line_ends[drop_line])
    if len(addresses):
        stops = np.nonzero(np.isin(points[:-1], _STOPS) & np.isin(points[1:], _AFTER_STOP))[0]
        stops = np.sort(np.concatenate([[-1], stops, line_ends]))
        to = np.searchsorted(stops, addresses)
        begin, finish = stops[to - 1] + 1, stops[to]
        gone |= _spans(size, begin, np.maximum(finish, begin))
    for opening, closing, longest in (("<", ">", LONGEST_TAG), ("{", "}", LONGEST_TAG), ("[", "]", LONGEST_BRACKET), ("(", ")", LONGEST_BRACKET)):
        begin, finish = _pairs(points, ord(opening), ord(closing), longest)
        if opening == "(":  # speech in brackets, to somebody
            aside = np.array([not _SPOKEN_TO.search(joined, a, b) for a, b in zip(begin, finish)], bool)
            begin, finish = begin[aside], finish[aside]
        gone |= _spans(size, begin, finish)
    stars, blank = points == STAR, (points == 32) | newline  # *a dog barks*
    before, after = np.concatenate([[True], blank[:-1]]), np.concatenate([blank[1:], [True]])
    marks = np.where(stars & before & ~after, 1, np.where(stars & after & ~before, 2, 0))
    gone |= _spans(size, *_pairs(marks, 1, 2, LONGEST_BRACKET))
    colons = np.nonzero(points == 58)[0]
    line = line_starts[np.searchsorted(line_ends, colons)]
    small_before = np.concatenate([[0], np.cumsum(real & ~is_upper[points], dtype=np.int32)])
    label = (colons - line <= LONGEST_LABEL) & (small_before[colons] == small_before[line]) & (real_before[colons] > real_before[line])
    gone |= _spans(size, line[label], colons[label] + 1)
    gone &= points != END

    doc = np.cumsum(points == END) - 1
    count = lambda mask: np.bincount(doc[mask], minlength=len(texts))
    speech = ~gone
    upper_count, letter_count, exclaims = count(speech & is_upper[points]), count(speech & real), count(speech & (points == 33))
    odd = count(speech & letter & (points > 0x24F))
    keep = speech & (codes != 0)
    codes, hyphen, place = codes[keep], (points[keep] == 45) | (points[keep] == 0x2010), np.nonzero(keep)[0]
    whole = ~_broken(codes, hyphen)
    codes, place = codes[whole], place[whole]
    # Runs of spaces become one; letters three times and more become one.
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    codes, place = codes[first], place[first]
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (codes[1:] != STAR)
    double = same.copy()
    double[1:] &= same[:-1]
    run = double.copy()  # in a run of three and more, drop all but its first
    run[:-1] |= double[1:] & same[:-1]
    drawn = np.add.reduceat(double, np.nonzero(codes == END)[0]) if len(texts) else np.zeros(0, int)
    codes, place = codes[~run], place[~run]
    codes[codes == ord("l")] = ord("i")  # l, I, 1 and | look alike
    codes, place, spaced = _joined(codes, place, len(texts))

    ends = np.nonzero(codes == END)[0]
    stars = np.add.reduceat(codes == STAR, ends) if len(texts) else np.zeros(0, int)
    codes[ends] = SPACE
    stops = np.nonzero((np.isin(points[:-1], _STOPS) & np.isin(points[1:], _AFTER_STOP)) | (points[:-1] == END))[0]
    return Plain(codes.tobytes().decode("latin-1"), np.concatenate([ends, [len(codes)]]), np.searchsorted(place, stops), letter_count, upper_count, exclaims, stars, odd, spaced, drawn)


def _broken(codes: np.ndarray, hyphen: np.ndarray) -> np.ndarray:
    """The hyphen and the white space after it, where a word is broken over lines: letter, hyphen, one or two spaces, letter."""
    broken = np.zeros(len(codes), bool)
    at = np.nonzero(hyphen[1:-3])[0] + 1 if len(codes) > 4 else np.zeros(0, int)
    is_letter = (codes >= 97) & (codes <= 122)
    at = at[is_letter[at - 1] & (codes[at + 1] == SPACE)]
    one, two = at[is_letter[at + 2]], at[(codes[at + 2] == SPACE) & is_letter[np.minimum(at + 3, len(codes) - 1)]]
    for hits, span in ((one, 2), (two, 3)):
        for step in range(span):
            broken[hits + step] = True
    return broken


def _joined(codes: np.ndarray, place: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three and more single letters with a space between them are one word."""
    alone = np.zeros(len(codes), bool)
    inner = (codes >= 97) & (codes <= 122) | (codes == STAR)
    if len(codes) > 2:
        alone[1:-1] = inner[1:-1] & (codes[:-2] == SPACE) & (codes[2:] == SPACE)
    at = np.nonzero(alone)[0]
    drop = np.zeros(len(codes), bool)
    found = at[:0]
    if len(at):
        new = np.concatenate([[True], np.diff(at) != 2])
        runs = np.nonzero(new)[0]
        lengths = np.diff(np.concatenate([runs, [len(at)]]))
        long = np.repeat(lengths >= 3, lengths)
        inside = long & ~new
        drop[at[inside] - 1] = True
        found = at[runs[lengths >= 3]]
    doc = np.searchsorted(np.nonzero(codes == END)[0], found, side="right") - 1
    return codes[~drop], place[~drop], np.bincount(doc, minlength=texts)[:texts] if texts else np.zeros(0, int)
