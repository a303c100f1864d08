"""The merge of neighbours as a plain fold over all blocks: what the parallel one must equal."""

from __future__ import annotations

from dataclasses import dataclass

from blockloom.functions.align import star
from blockloom.functions.partial_order import partial_order
from blockloom.operators.norm import Policy
from blockloom.sources.taf import link


def _sorted(rows: list[dict]) -> list[dict]:
    """Rows by name, strand (+ first) and start, the first one pinned."""
    return rows[:1] + sorted(rows[1:], key=lambda r: (r["sequence_name"], not r["strand"], r["start"]))


def _gap(left: dict, right: dict) -> int:
    return right["start"] - left["start"] - left["length"]


def _without_gap_columns(rows: list[dict], numbers: list[int]) -> tuple[list[dict], list[int]]:
    """Rows and their columns' numbers without the columns in which every row has a gap; one stays if there are no others."""
    used = [c for c, column in enumerate(zip(*(r["bases"] for r in rows))) if any(b != "-" for b in column)] or [0]
    if rows and len(used) < len(rows[0]["bases"]):
        rows, numbers = [r | {"bases": "".join(r["bases"][c] for c in used)} for r in rows], [numbers[c] for c in used]
    return rows, numbers


def prune(left: list[dict], rows: list[dict], to: list[int | None], most_gap: int) -> list[dict] | None:
    """Without the rows whose gap is too wide, if each is a copy (not the first row) of a genome that keeps another; else None."""
    genome = [r["sequence_name"].split(".", 1)[0] for r in rows]
    wide = [i is not None and _gap(left[i], r) > most_gap for r, i in zip(rows, to)]
    passing = {g for g, w in zip(genome, wide) if not w}
    drop = [k for k, w in enumerate(wide) if w]
    if not drop or any(k == 0 or genome.count(genome[k]) < 2 or genome[k] not in passing for k in drop):
        return None
    return [r for k, r in enumerate(rows) if k not in set(drop)]


def merge_pair(left: list[dict], right: list[dict], to: list[int | None], aligner: str) -> list[dict]:
    """One block of both: rows of the right block that continue nothing join at the place where they stood, the bases between are aligned."""
    width = len(left[0]["bases"])
    order: list[tuple[dict, dict | None]] = [(r, None) for r in left]
    place = {i: i for i in range(len(left))}  # where a left row stands in ``order``
    at = 0
    for r, i in zip(right, to):
        if i is None:
            new = {k: r[k] for k in ("sequence_name", "start", "strand", "sequence_length")} | {"length": 0, "bases": "-" * width}
            order.insert(at, (new, r))
            place = {k: p + (p >= at) for k, p in place.items()}
            at += 1
        else:
            order[place[i]] = (left[i], r)
            at = place[i] + 1
    between = []
    for l, r in order:
        n = _gap(l, r) if r is not None else 0
        given = r.get("left_gap_sequence") if r is not None else None
        between.append((given if isinstance(given, str) and len(given) == n else "N" * n).upper())
    aligned = {"star": star, "partial_order": partial_order}[aligner]([b for b in between if b])
    wide = len(aligned[0]) if aligned else 0
    rest = iter(aligned)
    out = []
    for (l, r), b in zip(order, between):
        middle = next(rest) if b else "-" * wide
        tail = r["bases"] if r is not None else "-" * len(right[0]["bases"])
        out.append(l | {"bases": l["bases"] + middle + tail, "length": l["length"] + (len(b) + r["length"] if r is not None else 0)})
    return out


@dataclass
class Merged:
    """A block made of others: where each of those begins in it, and the numbers of its columns that are left."""

    rows: list[dict]
    parts: list[tuple[int, int, list[int]]]  # block id, place, columns

    @property
    def block_id(self) -> int:
        return self.parts[0][0]


def fold(blocks: list[list[dict]], policy: Policy) -> list[Merged]:
    """Merge neighbours from left to right."""
    out: list[Merged] = []
    for block in blocks:
        block_id = block[0]["block_id"]
        block, numbers = _without_gap_columns(block, list(range(len(block[0]["bases"]))))
        block = _sorted(block)
        if out:
            left = out[-1].rows
            to = link(left, block, substitutions=False)
            shared = sum(i is not None for i in to)
            total = len(left) + len(block) - shared
            short = min(len(left[0]["bases"]), len(block[0]["bases"])) <= policy.most_block
            if shared >= policy.least_shared and shared >= total * policy.least_fraction and short:
                widest = lambda: max([_gap(left[i], r) for r, i in zip(block, to) if i is not None], default=0)
                while policy.prune and widest() > policy.most_gap:
                    fewer = prune(left, block, to, policy.most_gap)
                    if fewer is None:
                        break
                    block, numbers = _without_gap_columns(fewer, numbers)
                    to = link(left, block, substitutions=False)
                if widest() <= policy.most_gap:
                    rows = _sorted(merge_pair(left, block, to, policy.aligner))
                    begin = len(rows[0]["bases"]) - len(block[0]["bases"])
                    out[-1] = Merged(rows, [*out[-1].parts, (block_id, begin, numbers)])
                    continue
        out.append(Merged(block, [(block_id, 0, numbers)]))
    return out
