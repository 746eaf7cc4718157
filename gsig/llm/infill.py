"""Fill-in-middle transformation over texts kept as independent compressed frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Code points of a frame.
FRAME = 1 << 15
P, S, M = "<P>", "<S>", "<M>"
#: One of each for a process, as tasks run in processes with a single thread.
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def letters(text: str) -> np.ndarray:
    """Which code points are ASCII letters."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4") | 32
    return (x >= 97) & (x <= 122)


def starts(text: str, inside: bool) -> np.ndarray:
    """Where units begin: runs of ASCII letters, and every other character alone. inside: the text before ends with a letter."""
    is_letter = letters(text)
    before = np.append(inside, is_letter[:-1])[: len(is_letter)]
    return np.flatnonzero(~(is_letter & before))


class Archive:
    """A text as independent frames one after another, with the number of units and of code points that begin before each.

    Reading from a code point or from a unit decompresses the frame it lies in; the whole is one valid zstandard stream.
    """

    def __init__(self, data: bytes, sizes: list[int], units: list[int], chars: list[int]):
        self.data, self.ends, self.units, self.chars = data, np.cumsum([0, *sizes]), np.array(units), np.array(chars)
        self.last, self.read = -1, ""

    @staticmethod
    def of(text: str, frame: int = FRAME) -> tuple[bytes, list[int], list[int], list[int]]:
        """data, sizes of frames; units and code points before each frame, and their totals at the end."""
        out, units, inside = [], [0], False
        for at in range(0, len(text), frame):
            part = text[at : at + frame]
            units.append(units[-1] + len(starts(part, inside)))
            inside = bool(letters(part[-1])[0])
            out.append(PACK.compress(part.encode()))
        return b"".join(out), [len(x) for x in out], units, [*range(0, len(text), frame), len(text)]

    def frame(self, i: int) -> str:
        """One frame; the last one read is kept."""
        if i != self.last:
            self.last, self.read = i, UNPACK.decompress(self.data[self.ends[i] : self.ends[i + 1]]).decode()
        return self.read

    def cut(self, unit: int) -> int:
        """The code point where the unit of that number (from 0) begins; the text's end for the number of units."""
        if unit >= self.units[-1]:
            return int(self.chars[-1])
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        inside = i > 0 and bool(letters(self.frame(i - 1)[-1])[0])
        return int(self.chars[i] + starts(self.frame(i), inside)[unit - self.units[i]])

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[str]:
        """The text from one code point to another, frame by frame."""
        end = int(self.chars[-1]) if end is None else end
        i = int(np.searchsorted(self.chars, start, "right")) - 1
        while start < end:
            base, to = int(self.chars[i]), min(end, int(self.chars[i + 1]))
            yield self.frame(i)[start - base : to - base]
            start, i = to, i + 1

    def holds(self, *marks: str) -> bool:
        """Whether any of the marks is in the text, also across a border of frames."""
        most, tail = max(map(len, marks)), ""
        for part in self.stream():
            seen = tail + part
            if any(m in seen for m in marks):
                return True
            tail = seen[-most + 1 :]
        return False


def drawn(doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that depend on doc_id only; a null one counts as no digits."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def plan(archive: Archive, doc_id: int | None) -> tuple[str, int, int]:
    """The form, and the code points where prefix and middle end."""
    n, (h1, h2, h3, h4) = int(archive.units[-1]), drawn(doc_id)
    if not n or h3 % 100 >= 90 or archive.holds(P, S, M):
        return "plain", 0, 0
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < 20 else "psm", archive.cut(first), archive.cut(second)


def output(archive: Archive, form: str, a: int, b: int) -> Iterator[str]:
    """The transformed text in parts."""
    if form == "plain":
        yield from archive.stream()
        return
    parts = {P: (0, a), S: (b, None), M: (a, b)}
    for mark in (P, S, M) if form == "psm" else (S, P, M):
        yield mark
        yield from archive.stream(*parts[mark])


def marks_in(out: Archive, form: str) -> list[tuple[str, int]]:
    """Each mark of the form and the code point where it begins in an output. Texts that hold a mark are plain, so the first ones count."""
    found, at, tail = [], 0, ""
    for part in out.stream():
        seen = tail + part
        for mark in (P, S, M):
            if (i := seen.find(mark)) >= 0 and mark not in dict(found):
                found.append((mark, at - len(tail) + i))
        at, tail = at + len(part), seen[-2:]
    return found


def restored(out: Archive, form: str) -> Iterator[str]:
    """The original text in parts, from an output and its form alone."""
    if form == "plain":
        yield from out.stream()
        return
    found = sorted(marks_in(out, form), key=lambda x: x[1])
    ends = [at for _, at in found[1:]] + [int(out.chars[-1])]
    parts = {mark: (at + len(mark), end) for (mark, at), end in zip(found, ends, strict=True)}
    for mark in (P, M, S):
        yield from out.stream(*parts[mark])


def digest(parts: Iterator[str]) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(part.encode())
    return h.hexdigest()


FRAMES = "data binary, sizes array<int>, units array<long>, chars array<long>"


def stored(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """doc_id, data, sizes, units, chars: each whole text as frames of `frame` code points and its index; to be written or read on."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                rows = [(doc_id, *Archive.of(text or "", frame)) for doc_id, text in zip(some["doc_id"], some["text"], strict=True)]
                yield pd.DataFrame(rows, columns=["doc_id", "data", "sizes", "units", "chars"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pack, f"doc_id long, {FRAMES}")


def archives(part: pd.DataFrame) -> Iterator[tuple[int | None, Archive]]:
    for doc_id, data, sizes, units, chars in zip(*(part[c] for c in ("doc_id", "data", "sizes", "units", "chars")), strict=True):
        yield None if pd.isna(doc_id) else int(doc_id), Archive(data, list(sizes), list(units), list(chars))


def transformed(frames: DataFrame) -> DataFrame:
    """doc_id, form, prefix_chars, middle_chars, text: the outputs themselves, from what stored() returns."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                rows = []
                for doc_id, archive in archives(part.iloc[at : at + 256]):
                    form, a, b = plan(archive, doc_id)
                    rows.append((doc_id, form, *((None, None) if form == "plain" else (a, b - a)), "".join(output(archive, form, a, b))))
                yield pd.DataFrame(rows, columns=["doc_id", "form", "prefix_chars", "middle_chars", "text"]).astype({c: "Int64" for c in ("doc_id", "prefix_chars", "middle_chars")})

    return frames.mapInPandas(write, "doc_id long, form string, prefix_chars long, middle_chars long, text string")


def report(frames: DataFrame) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output_sha256, restored_sha256 for every row
    of what stored() returns.

    Units are runs of ASCII letters and every other character alone. Two numbers drawn from doc_id cut the text at units, the frames
    with the cuts are decompressed to find their code points, and the output is read as a stream of frames in its order. It is kept in frames
    again, from which, with the form alone, the original is restored.
    Null texts count as empty; they, and texts that hold a mark, are plain. A null doc_id counts as no digits. Texts may be of any length: one
    frame at a time is read. Rows that repeat are transformed alike; an empty table gives no rows; extra columns are not read.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, archive in archives(part):
                form, a, b = plan(archive, doc_id)
                out = rewritten(output(archive, form, a, b))
                rows.append((doc_id, int(archive.units[-1]), form, *((None, None) if form == "plain" else (a, b - a)), digest(out.stream()), digest(restored(out, form))))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]).astype({c: "Int64" for c in ("doc_id", "prefix_chars", "middle_chars")})

    return frames.mapInPandas(read, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def rewritten(parts: Iterator[str]) -> Archive:
    """A stream as an archive with a frame for each part that isn't empty; units are not counted."""
    out, chars = [], [0]
    for part in parts:
        if part:
            out.append(PACK.compress(part.encode()))
            chars.append(chars[-1] + len(part))
    return Archive(b"".join(out), [len(x) for x in out], [0] * len(chars), chars)
