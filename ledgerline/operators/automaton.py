"""Many phrases found in one pass over a text, whatever their number.

Texts are cleaned (letters lower-cased; what is no letter, digit or plus sign of ASCII becomes a space; spaces
collapse), with a run-length map from cleaned to original positions. An automaton over the phrases, held as arrays, is
stepped through a batch of texts in many lanes at once: a lane begins as many characters early as the longest
phrase has, after which its state no longer depends on where it began.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a cleaned text: what separates texts, a space, letters, digits, plus. Each is a symbol by its place.
SYMBOLS = "\n abcdefghijklmnopqrstuvwxyz0123456789+"
#: Cells of an automaton (4 bytes each): more phrases are dealt over several, each a pass.
MOST_CELLS = 16_000_000
#: Characters of texts that are cleaned at once (some 40 bytes each), and characters a lane reads.
AT_ONCE, LANE = 2_000_000, 512
_HITS = "array<struct<phrase:int,at:int,to:int>>"
_LETTERS = np.ones(256, np.uint8)
for _i, _c in enumerate(SYMBOLS):
    if _c > " ":
        _LETTERS[ord(_c)] = _LETTERS[ord(_c.upper())] = _i


def cleaned(text: Column) -> Column:
    """The cleaned form of a text, as phrases are given and texts are searched."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9+]+", " "))


class Automaton:
    """Arrays of an automaton over phrases (cleaned, distinct): next states by symbol, and the phrases that end at a state."""

    def __init__(self, phrases: list[str]):
        self.sizes = np.array([len(p) for p in phrases], np.int64)
        self.longest = int(max(self.sizes, default=0)) + 2
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, phrase in enumerate(phrases):
            state = 0
            for c in f" {phrase} ":
                symbol = SYMBOLS.index(c)
                if symbol not in children[state]:
                    children[state][symbol] = len(children)
                    children.append({})
                    ends.append(-1)
                state = children[state][symbol]
            ends[state] = number
        self.next = np.zeros((len(children), len(SYMBOLS)), np.int32)
        self.phrase = np.array(ends, np.int32)  # the phrase that ends at a state
        self.shorter = np.zeros(len(children), np.int32)  # the nearest state of a suffix at which a phrase ends; 0: none
        suffix = np.zeros(len(children), np.int32)
        level = [0]
        while level:  # breadth first, so that a state's suffix is complete before it
            below = []
            for state in level:
                self.next[state] = self.next[suffix[state]] if state else 0
                for symbol, child in children[state].items():
                    suffix[child] = self.next[suffix[state], symbol] if state else 0
                    self.next[state, symbol] = child
                    below.append(child)
            for child in below:
                s = suffix[child]
                self.shorter[child] = s if self.phrase[s] >= 0 else self.shorter[s]
            level = below
        self.ends = (self.phrase >= 0) | (self.shorter > 0)

    def found(self, symbols: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position after its last character) of all hits in an array of symbols; overlapping ones too."""
        ahead = self.longest - 1
        lanes = max(1, -(-len(symbols) // lane))
        padded = np.zeros(ahead + lanes * lane, np.uint8)
        padded[ahead : ahead + len(symbols)] = symbols
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, ahead + lane), (lane, 1)).T)
        flat, width, state = self.next.ravel(), self.next.shape[1], np.zeros(lanes, np.int32)
        at, states = [], []
        for i, row in enumerate(steps):
            state = flat[state * width + row]
            if i >= ahead:
                hit = np.flatnonzero(self.ends[state])
                if len(hit):
                    at.append(hit * lane + (i - ahead))
                    states.append(state[hit])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, states = np.concatenate(at), np.concatenate(states)
        numbers, places = [], []
        while len(at):
            own = self.phrase[states] >= 0
            numbers.append(self.phrase[states[own]])
            places.append(at[own])
            states = self.shorter[states]
            at, states = at[states > 0], states[states > 0]
        return np.concatenate(numbers).astype(np.int64), np.concatenate(places)  # at: the space that follows


def _batches_of(column: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, firsts) of runs of texts of about ``most`` bytes; nulls are empty."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, "right")) - 1)
        end = min(end, len(column))
        yield begin, body[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin]
        begin = end


def _symbols(body: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts, each between spaces and behind a separator; the original position (code points) of each; where texts begin."""
    marks = np.repeat(firsts[:-1], 2)
    tails = firsts[1:]
    points = np.cumsum((body & 0xC0) != 0x80) - 1
    before = np.concatenate([[0], points + 1])[firsts]  # code points before each text
    own = np.repeat(before[:-1], np.diff(firsts))
    place = np.concatenate([marks, tails])
    value = np.concatenate([np.tile(np.array([0, 1], np.uint8), len(tails)), np.ones(len(tails), np.uint8)])
    where = np.concatenate([np.full(2 * len(tails), -1), np.diff(before)])
    # Stable by place, and at one place the end of a text before the beginning of the next.
    text = np.concatenate([np.repeat(np.arange(len(tails)), 2), np.arange(len(tails))])
    order = np.lexsort((np.concatenate([np.tile([0, 1], len(tails)), np.full(len(tails), 2)]), text))
    symbols = np.insert(_LETTERS[body], place[order], value[order])
    origin = np.insert(points - own, place[order], where[order])
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~((symbols[1:] == 1) & (symbols[:-1] == 1))
    symbols, origin = symbols[keep], origin[keep]
    return symbols, origin, np.flatnonzero(symbols == 0)


def _scanner(automata: list[tuple[int, Automaton]], keys: int, names: list[str], clean: bool) -> Callable:
    letters = np.frombuffer(SYMBOLS.encode(), np.uint8)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(keys)
            for row, body, firsts in _batches_of(column):
                symbols, origin, begins = _symbols(body, firsts)
                n = len(begins)
                hits = [(first + p, at - a.sizes[p], at) for first, a in automata for p, at in [a.found(symbols)]]
                phrase, start, end = (np.concatenate([h[i] for h in hits] or [np.zeros(0, np.int64)]) for i in range(3))
                order = np.lexsort((phrase, start))
                phrase, start, end = phrase[order], start[order], end[order]
                base = begins + 1  # position 0 is the leading space
                of = np.searchsorted(begins, start, "right") - 1
                found = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (phrase, start - base[of], end - base[of])], ["phrase", "at", "to"])
                counts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
                # Runs of the map: where the distance between cleaned and original positions changes.
                inside = np.searchsorted(begins, np.arange(len(symbols)), "right") - 1
                shift = origin - (np.arange(len(symbols)) - base[inside])
                new = np.flatnonzero((symbols != 0) & np.concatenate([[True], (np.diff(shift) != 0) | (np.diff(inside) != 0) | (symbols[:-1] == 0)]))
                runs = np.concatenate([[0], np.cumsum(np.bincount(inside[new], minlength=n))])
                out = [batch.column(i).slice(row, n) for i in range(keys)]
                out.append(pa.ListArray.from_arrays(pa.array(counts, pa.int32()), found))
                for values in (new - base[inside[new]], shift[new]):
                    out.append(pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.array(values, pa.int32())))
                if clean:
                    ends = np.concatenate([begins[1:], [len(symbols)]])
                    out.append(pa.array([letters[symbols[a + 1 : b]].tobytes().decode() for a, b in zip(begins, ends, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    return scan


def scanned(files: DataFrame, keys: list[str], text: Column, phrases: list[str], clean: bool = False, most_cells: int = MOST_CELLS) -> DataFrame:
    """keys, hits, starts, shifts (and clean) for every row of files: one pass over the texts.

    phrases: cleaned, distinct, not empty. hits: phrase (number), at and to (characters of the cleaned text, which is
    between two spaces), sorted by at; a phrase is found as whole words only. starts and shifts: runs of the map to the
    original text, see original_position(). Null texts are empty.
    """
    if len(set(phrases)) < len(phrases) or any(not p.strip() or set(p) - set(SYMBOLS[1:]) for p in phrases):
        raise ValueError("phrases must be cleaned, distinct and not empty")
    blocks, cells = [[]], 0
    for p in phrases:
        cells += (len(p) + 2) * len(SYMBOLS)
        if cells > most_cells and blocks[-1]:
            blocks.append([])
            cells = (len(p) + 2) * len(SYMBOLS)
        blocks[-1].append(p)
    firsts = [sum(len(b) for b in blocks[:i]) for i in range(len(blocks))]
    automata = [(first, Automaton(b)) for first, b in zip(firsts, blocks, strict=True) if b]
    rows = files.select(*keys, text.cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema += f", hits {_HITS}, starts array<int>, shifts array<int>" + ", clean string" * clean
    names = [*keys, "hits", "starts", "shifts"] + ["clean"] * clean
    return rows.withColumn("_text", F.coalesce("_text", F.lit(""))).mapInArrow(_scanner(automata, len(keys), names, clean), schema)


def original_position(starts: Column, shifts: Column, at: Column) -> Column:
    """Where the character at a position of a cleaned text stands in the original one: a binary search for its run."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(starts) + 1)).cast("int") + 1)
    half = lambda r: ((r["lo"] + r["hi"]) / 2).cast("int")
    step = lambda r, _: F.when(r["lo"] >= r["hi"], r).when(F.element_at(starts, half(r) + 1) <= at, F.struct((half(r) + 1).alias("lo"), r["hi"].alias("hi"))).otherwise(F.struct(r["lo"].alias("lo"), half(r).alias("hi")))
    run = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi")), step)["lo"]
    return at + F.element_at(shifts, run)


def original_spans(starts: Column, shifts: Column, spans: Column) -> Column:
    """spans (at, to) of a cleaned text as (start, end) of the original one."""
    return F.transform(spans, lambda x: F.struct(original_position(starts, shifts, x["at"]).alias("start"), (original_position(starts, shifts, x["to"] - 1) + 1).alias("end")))
