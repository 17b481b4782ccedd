"""URL filters by a bit-parallel wildcard automaton.

Glob rules become one nondeterministic automaton: a bit for every position in every pattern, packed
into 64-bit words. A byte of a URL moves all bits of all patterns at once (Shift-And): shifted
bits stay where the byte is the pattern's next letter, and bits before a wildcard stay where they
are. URLs of a batch advance together, so a step is a few array operations for all of them.

``*`` stands for any characters but ``/`` and ``?``, ``**`` for any. A pattern has to match the whole
canonical URL: host in lower case, path, and query; scheme and fragment are left out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: URLs and bytes that advance together: bounds the memory of a task.
ROWS_AT_ONCE = 20_000
_DOMAIN_RANK = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Globs that mean the same; of the rules that match, the one of highest rank decides."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    rank: int


def domain_rule(host: str, path: str, verdict: str) -> Rule:
    """For a host with its subdomains, and paths that start with ``path``; the longest decides, and
    any decides before a plain glob."""
    for text in (host, path):
        if "*" in text:
            raise ValueError(f"a wildcard in {text!r}")
    globs = (f"{host}{path}**", f"*.{host}{path}**")
    return Rule(host + path, verdict, globs, _DOMAIN_RANK + len(host) + len(path))


def glob_rules(globs: Sequence[str], verdict: str) -> list[Rule]:
    return [Rule(g, verdict, (g,), len(g)) for g in globs]


class Automaton:
    """All globs of all rules, as masks over words of 64 positions."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        moves: list[int | None] = []  # letter that leads to a position
        stays: list[str] = []  # wildcard at a position
        self.start, self.final = [], []  # positions, final ones with the number of their rule
        for number, rule in enumerate(self.rules):
            for glob in rule.globs:
                self.start.append(len(moves))
                moves.append(None)
                stays.append("")
                for part in re.findall(rb"\*+|[^*]", glob.encode(), re.DOTALL):
                    if part[:1] == b"*":
                        stays[-1] = max(stays[-1], "**" if len(part) > 1 else "*", key=len)
                    else:
                        moves.append(part[0])
                        stays.append("")
                self.final.append((len(moves) - 1, number))
        words = (len(moves) + 63) // 64
        self.move = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        self.first = np.zeros(words, np.uint64)
        narrow = np.array([b not in b"/?" for b in range(256)])
        for at, (letter, wild) in enumerate(zip(moves, stays, strict=True)):
            bit = np.uint64(1 << at % 64)
            if letter is not None:
                self.move[letter, at // 64] |= bit
            if wild:
                self.stay[narrow if wild == "*" else slice(None), at // 64] |= bit
        for at in self.start:
            self.first[at // 64] |= np.uint64(1 << at % 64)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """Which rules match: URLs x rules."""
        out = np.zeros((len(urls), len(self.rules)), bool)
        length = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(urls[i] for i in order) + b"\0", np.uint8)
        length = length[order]
        begin = np.cumsum(length) - length
        state = np.tile(self.first, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        active = len(urls)
        for step in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length[:active], -step, "left"))
            letter = data[begin[:active] + step]
            now = state[:active]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:active] = (shifted & self.move[letter]) | (now & self.stay[letter])
        for at, number in self.final:
            out[order, number] |= (state[:, at // 64] >> np.uint64(at % 64) & one).astype(bool)
        return out


def parts(url: Column) -> dict[str, Column]:
    """Host, path and query of a URL. Without ``://`` or a URL all are empty. The host runs from the
    first ``://`` to ``/``, ``?``, ``#`` or the end, with ASCII letters in lower case."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1),
    }


def judge(url: Column, rules: Sequence[Rule], otherwise: str = "allow") -> Column:
    """``struct<rule, verdict>``: the matching rule of highest rank (of equal ones the first) and
    its verdict; no rule and ``otherwise`` where none matches, as for a missing URL. Equal URLs are
    judged alike, a URL of any length by all its characters; an empty table has no verdicts."""
    automaton = Automaton(rules)
    ranked = sorted(range(len(automaton.rules)), key=lambda i: -automaton.rules[i].rank)
    names = [automaton.rules[i].name for i in ranked] + [None]
    verdicts = [automaton.rules[i].verdict for i in ranked] + [otherwise]

    @F.arrow_udf("rule string, verdict string")
    def of_batch(data: pa.Array) -> pa.Array:
        chosen = []
        for a in range(0, len(data), ROWS_AT_ONCE):
            hit = automaton.matches(data.slice(a, ROWS_AT_ONCE).to_pylist())[:, ranked]
            last = np.ones((len(hit), 1), bool)
            chosen.append(np.concatenate([hit, last], axis=1).argmax(axis=1))
        at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [
                pa.array(names, pa.string()).take(pa.array(at)),
                pa.array(verdicts, pa.string()).take(pa.array(at)),
            ],
            ["rule", "verdict"],
        )

    own = parts(url)
    return of_batch(F.concat(own["host"], own["path"], own["query"]).cast("binary"))
