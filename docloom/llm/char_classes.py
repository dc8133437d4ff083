"""The tokenizer library's character classes for engines with other Unicode tables.

Java, Python's regex module and the tiktoken library each know another version of
Unicode, so ``\\p{L}`` means other letters in each. The library itself is asked once which
code points it takes for letters, numbers and white space; an engine's own classes are
found the same way, and a pattern's classes get the difference added and taken away.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SIZE = 0x110000
ATOMS = {"letter": r"\p{L}", "number": r"\p{N}", "space": r"\s"}
#: The pattern's other classes follow from these: neither of the three, and no space.
OTHER, SOLID = r"[^\s\p{L}\p{N}]", r"\S"


@cache
def every_character() -> str:
    return "".join(chr(c) for c in range(SIZE) if not 0xD800 <= c < 0xE000)


def _members(found: str) -> np.ndarray:
    out = np.zeros(SIZE, bool)
    out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = True
    return out


def _with_rest(classes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    real = _members(every_character())
    solid = real & ~classes["space"]
    return {ATOMS[k]: v for k, v in classes.items()} | {SOLID: solid, OTHER: solid & ~classes["letter"] & ~classes["number"]}


@cache
def library_classes() -> dict[str, np.ndarray]:
    """What the library matches: of a text of all characters only those are encoded, and decoded again."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    ask = lambda p: (e := tiktoken.Encoding("classes", pat_str=p, mergeable_ranks=ranks, special_tokens={})).decode_bytes(e.encode_ordinary(every_character())).decode()
    return _with_rest({k: _members(ask(p)) for k, p in ATOMS.items()})


@cache
def regex_classes() -> dict[str, np.ndarray]:
    import regex

    return _with_rest({k: _members("".join(regex.findall(p, every_character()))) for k, p in ATOMS.items()})


_java: dict[str, dict[str, np.ndarray]] = {}


def java_classes(spark: SparkSession) -> dict[str, np.ndarray]:
    """The classes of the executors' Java, by one small job for each application."""
    app, step = spark.sparkContext.applicationId, 4096
    if app not in _java:
        chars = every_character()
        rows = spark.createDataFrame([(chars[i : i + step],) for i in range(0, len(chars), step)], "t string")
        cut = [F.array_join(F.regexp_extract_all("t", F.lit(f"(?U){p}"), F.lit(0)), "").alias(k) for k, p in ATOMS.items()]
        found = rows.select(*cut).collect()
        _java.clear()
        _java[app] = _with_rest({k: _members("".join(r[k] for r in found)) for k in ATOMS})
    return _java[app]


def _ranges(members: np.ndarray, escape: str) -> tuple[str, int]:
    """Character ranges of a class, and the first code point."""
    at = np.flatnonzero(members)
    breaks = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
    return "".join(f"{escape % a}-{escape % b}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), int(at[0])


def corrected(pattern: str, own: dict[str, np.ndarray], escape: str, java: bool) -> str:
    """The pattern with the library's classes, for an engine whose classes are ``own``.

    Differences start far beyond the common letters, so a look at the code point's range
    comes before the long list of ranges.
    """
    wanted, top = library_classes(), escape % 0x10FFFF
    written, marks = pattern, {}
    for n, atom in enumerate([OTHER, *ATOMS.values(), SOLID]):
        more, less = wanted[atom] & ~own[atom], own[atom] & ~wanted[atom]
        text = atom
        if more.any():
            ranges, least = _ranges(more, escape)
            text = f"[{text}[[{escape % least}-{top}]&&[{ranges}]]]"
        if less.any():
            ranges, least = _ranges(less, escape)
            text = f"[{text}&&[{escape % 0}-{escape % (least - 1)}[^{ranges}]]]" if java else f"[{text}--[[{escape % least}-{top}]&&[{ranges}]]]"
        # A mark of its own, so that what stands for one class is not read as another's.
        marks[chr(0xE000 + n)] = text
        written = written.replace(atom, chr(0xE000 + n))
    for mark, text in marks.items():
        written = written.replace(mark, text)
    return written


def java_pattern(spark: SparkSession, pattern: str) -> str:
    return "(?U)" + corrected(pattern, java_classes(spark), r"\x{%x}", java=True)


@cache
def regex_pattern(pattern: str) -> str:
    return "(?V1)" + corrected(pattern, regex_classes(), r"\U%08x", java=False)
