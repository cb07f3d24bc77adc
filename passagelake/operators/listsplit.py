"""Splitting one list that is over the word limit: a fold in order, for the few lists that need it."""

from __future__ import annotations

import re

#: White-space separated words of a list child at most.
LIMIT = 500
#: What begins a top-level item, and any item.
_TOP = re.compile(r"^(?:-|\d+\.)\s")
_MARKED = re.compile(r"^\s*(?:-|\d+\.)\s|^[a-z]\.\s|^[a-z]\s(?=[A-Z])")


def split_list(entries: list, limit: int = LIMIT) -> list[list]:
    """The pieces of a list over the limit. entries: (line, ...) tuples; words are counted by white space.

    Top-level items are packed while they fit. An item over the limit is packed from its nested items,
    its first line repeated in each piece; a nested item over the limit from its lines.
    """
    return [[entries[i] for i in at] for _, at in split_places([e[0] for e in entries], limit)]


def split_places(lines: list[str], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """split_list by places: (words, places of lines) of each piece. A line's words are counted once."""
    counts = [len(line.split()) for line in lines]
    size = lambda part: sum(counts[i] for i in part)

    def pack(parts: list[list], head: list, keep: bool) -> list[tuple[int, list]]:
        """Greedy packing; each piece begins with head. keep: whether a piece of head alone counts."""
        own = size(head)
        out, piece, total = [], list(head), own
        for part in parts:
            n = size(part)
            if (keep or len(piece) > len(head)) and piece and total + n > limit:
                out.append((total, piece))
                piece, total = list(head), own
            piece += part
            total += n
        if piece and (keep or len(piece) > len(head)):
            out.append((total, piece))
        return out

    def grouped(part, starts) -> list[list]:
        out: list[list] = []
        for i in part:
            if not out or starts(lines[i]):
                out.append([])
            out[-1].append(i)
        return out

    every = range(len(lines))
    if (words := sum(counts)) <= limit:
        return [(words, list(every))]
    out, run = [], []
    for item in [*grouped(every, lambda s: _TOP.match(s)), None]:
        if item is not None and size(item) <= limit:
            run.append(item)
            continue
        out += pack(run, [], False)
        run = []
        if item is None:
            continue
        head, rest = item[:1], item[1:]
        if not rest:
            out.append((size(item), item))
            continue
        held: list[list] = []
        for nested in grouped(rest, lambda s: s[:1].isspace() and _MARKED.match(s.lstrip())):
            if size(nested) + size(head) <= limit:
                held.append(nested)
                continue
            out += pack(held, head, False)
            held = []
            out += pack([[i] for i in nested], head, True)
        out += pack(held, head, False)
    return out
