"""Chat formatting (operator 7): transcript parsing by a hidden Markov model.

A transcript is plain text, one speaker's turn after another, with or without
speaker marks. Each line is observed through its mark, its length, how it
begins and ends, and whether a blank line stands before it. Hidden states are a
role together with "begins a turn" or "goes on"; their transitions and
observations are counted on labelled transcripts. Viterbi's algorithm finds the
likeliest states, and the turns they spell are rendered in one canonical form.

A conversation of any length is decoded as a whole, though no task ever holds it:
its transcript comes in parts; each part is first reduced to the best score from
every state before it to every state at its end, a pass over these small rows finds
the states at the parts' ends, and then every part is decoded between its two. The
parts' rendered chats, one after another, are the chat of the whole transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Turn numbers of a conversation in one part of its transcript.
SEGMENT = 256
#: Marks that name a speaker, by role; the second list is for whole heading lines.
MARKS = {"system": ("System", "Instructions", "Context"), "user": ("User", "Human", "Q"), "assistant": ("Assistant", "AI", "A"), "tool": ("Tool", "Function", "Observation")}
HEADINGS = {"system": "### System:", "user": "### Instruction:", "assistant": "### Response:", "tool": "### Tool:"}
_ROLE_OF = {m.lower(): r for r, ms in MARKS.items() for m in ms}
_HEADING_OF = {h: r for r, h in HEADINGS.items()}
_MARK = re.compile(r"^(\w{1,12}): ?")


def observe(line: str, after_blank: bool) -> tuple[str, ...]:
    """The line's features, each a name and a value in one string."""
    found = _MARK.match(line)
    if line in _HEADING_OF:
        mark = "heading " + _HEADING_OF[line]
    elif found:
        mark = "mark " + _ROLE_OF.get(found[1].lower(), "other")
    else:
        mark = "none"
    begin = "empty" if not line else "upper" if line[0].isupper() else "lower" if line[0].isalpha() else "sign"
    return (f"m {mark}", f"l {min(5, len(line).bit_length() // 2)}", f"b {begin}", f"e {line[-1:] if line[-1:] in '?.:' else ''}", f"g {int(after_blank)}")


def lines_of(text: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(line, features, blank lines before it) of a transcript."""
    out, blank = [], 0
    for line in text.split("\n"):
        if not line.strip():
            blank += 1
            continue
        out.append((line, observe(line, blank > 0), blank))
        blank = 0
    return out


class Hmm:
    """Log start, transition and observation tables from counts, smoothed."""

    def __init__(self, counts: dict[tuple[str, int, str], float]):
        n = len(STATES)
        self.start, self.move = np.full(n, 0.1), np.full((n, n), 0.1)
        names = sorted({v for k, _, v in counts if k == "o"})
        self.seen = {v: np.full(n, 0.1) for v in names}
        for (kind, state, value), x in counts.items():
            if kind == "s":
                self.start[state] += x
            elif kind == "t":
                self.move[state, int(value)] += x
            else:
                self.seen[value][state] += x
        for kind in {v.split(" ")[0] for v in names}:  # each feature's values sum to one
            own = [v for v in names if v.split(" ")[0] == kind]
            total = sum(self.seen[v] for v in own)
            for v in own:
                self.seen[v] = np.log(self.seen[v] / total)
        self.start, self.move = np.log(self.start / self.start.sum()), np.log(self.move / self.move.sum(1, keepdims=True))

    def _scores(self, features: list[tuple[str, ...]]) -> list[np.ndarray]:
        none = np.zeros(len(STATES))
        return [sum((self.seen.get(v, none) for v in f), none) for f in features]

    def viterbi(self, features: list[tuple[str, ...]], before: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states, between the state ``before`` the first line and the
        ``last`` one if they are given; ties go to the earlier state of the list."""
        if not features:
            return []
        seen = self._scores(features)
        best, back = (self.start if before is None else self.move[before]) + seen[0], []
        for x in seen[1:]:
            way = best[:, None] + self.move
            back.append(way.argmax(0))
            best = way.max(0) + x
        state = [int(best.argmax()) if last is None else last]
        for step in reversed(back):
            state.append(int(step[state[-1]]))
        return state[::-1]

    def across(self, features: list[tuple[str, ...]]) -> np.ndarray | None:
        """Best scores to each state at the end: from each state before the lines, and in
        the last row from the start of a text; None without lines."""
        if not features:
            return None
        seen = self._scores(features)
        best = np.vstack([self.move, self.start]) + seen[0]
        for x in seen[1:]:
            best = (best[:, :, None] + self.move).max(1) + x
        return best

    def parse(self, text: str, before: int | None = None, last: int | None = None) -> tuple[list[tuple[str, str]], bool]:
        """(role, text) of each turn of a transcript, and whether the first goes on
        with the turn of the state ``before``. Blank lines within a turn stay."""
        lines = lines_of(text)
        turns: list[tuple[str, list[str]]] = []
        role = None if before is None else STATES[before][0]
        goes_on = False
        for (line, _, blank), s in zip(lines, self.viterbi([f for _, f, _ in lines], before, last), strict=True):
            own, begins = STATES[s]
            if begins or own != role:
                role = own
                turns.append((own, []))
                if _HEADING_OF.get(line) == own:
                    continue
                found = _MARK.match(line)
                line = line[found.end() :] if found and _ROLE_OF.get(found[1].lower()) == own else line
            else:
                if not turns:
                    goes_on = True
                    turns.append((own, []))
                if goes_on or turns[-1][1]:
                    turns[-1][1].extend([""] * blank)
            turns[-1][1].append(line)
        return [(r, "\n".join(x)) for r, x in turns], goes_on


def render(turns: Iterable[tuple[str, str]]) -> str:
    """The canonical form: every turn between <|role|> and <|end|>."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def render_part(turns: list[tuple[str, str]], goes_on: bool, first: bool, final: bool) -> str:
    """A part of the canonical form: the turn before it, which its end leaves open,
    goes on or is closed at its beginning; only the final part closes its last turn."""
    if not turns:
        return "" if first or not final else "\n<|end|>\n"
    out = "" if first or goes_on else "\n<|end|>\n"
    for k, (role, text) in enumerate(turns):
        out += "\n" + text if k == 0 and goes_on else f"<|{role}|>\n{text}"
        out += "\n<|end|>\n" if k < len(turns) - 1 or final else ""
    return out


def transcript(turns: list[tuple[str, str]], style: int) -> tuple[str, list[tuple[str, bool]]]:
    """A raw transcript of turns and the true (role, begins) of its lines.

    Styles 0 to 2 put a mark before each turn, 3 a heading line, 4 marks only the
    first turn of each role and empty turns, and sets turns apart by blank lines.
    Blank lines at a turn's ends are left out, those within stay.
    """
    lines, truth, met = [], [], set()
    for role, text in turns:
        role = role if role in ROLES else "user"
        own = text.split("\n")
        while own and not own[0].strip():
            own.pop(0)
        while own and not own[-1].strip():
            own.pop()
        if style == 3:
            own = [HEADINGS[role], *own]
        elif style < 3 or role not in met or not own:
            own = [f"{MARKS[role][style % 3]}: {own[0] if own else ''}", *own[1:]]
        met.add(role)
        if lines and style == 4:
            lines.append("")
        lines += own
        truth += [(role, k == 0) for k, x in enumerate(own) if x.strip()]
    return "\n".join(lines), truth


def transcripts(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, part, text, truth) of every conversation, one row per ``SEGMENT`` turn numbers.

    Turns of equal number stand in the order of role and text, repeated rows are
    repeated turns. A null role or text counts as '', a null turn number as 0; rows
    of null id are one conversation. An unknown role counts as the user's.
    """
    c = conversations.select(F.col(id_col).cast("long").alias("c"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("n"), F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("t"))
    c = c.withColumn("part", F.floor(F.col("n") / SEGMENT)).select("c", "part", "n", "r", "t")

    def run(batches):
        key, turns = None, []

        def close():
            style = ((key[0] or 0) * 2654435761 >> 7) % 5
            text, truth = transcript(turns, style)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([text]), pa.array([" ".join(f"{STATES.index(x)}" for x in truth)])], names=["c", "part", "text", "truth"])

        for batch in batches:
            for c, part, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if (c, part) != key:
                    if key:
                        yield close()
                    key, turns = (c, part), []
                turns.append((r, t))
        if key:
            yield close()

    return c.repartition("c", "part").sortWithinPartitions("c", "part", "n", "r", "t").mapInArrow(run, "c long, part long, text string, truth string")


def train(labelled: DataFrame) -> Hmm:
    """Count transitions and observations of (text, truth) rows; the counts are
    as many as states and feature values allow, whatever the number of rows."""

    def run(batches):
        counts: dict[tuple[str, int, str], int] = {}
        for batch in batches:
            for text, truth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                states = [int(x) for x in truth.split()]
                for s, (_, features, _) in zip(states, lines_of(text), strict=True):
                    for f in features:
                        counts["o", s, f] = counts.get(("o", s, f), 0) + 1
                if states:
                    counts["s", states[0], ""] = counts.get(("s", states[0], ""), 0) + 1
                for a, b in zip(states, states[1:], strict=False):
                    counts["t", a, str(b)] = counts.get(("t", a, str(b)), 0) + 1
        k = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.int32()), pa.array([x[2] for x in k], pa.string()), pa.array([counts[x] for x in k], pa.int64())], names=["k", "s", "v", "n"])

    got = labelled.select("text", "truth").mapInArrow(run, "k string, s int, v string, n long").groupBy("k", "s", "v").agg(F.sum("n").alias("n")).collect()
    return Hmm({(r[0], r[1], r[2]): r[3] for r in got})


def ends(parts: DataFrame, hmm: Hmm) -> DataFrame:
    """(c, part, before, last, first, final): the states before and at the end of every
    part of a transcript, on the likeliest path of the whole; null where there is none.

    Only a few numbers of each part pass through: forwards for the best scores,
    backwards for the path. A conversation's numbers stream through one task."""
    n = len(STATES)

    def reduce_part(batches):
        for batch in batches:
            found = [hmm.across([f for _, f, _ in lines_of(t or "")]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], names=["c", "part", "m"])

    def forwards(batches):
        key, best = object(), None
        for batch in batches:
            back, top, first = [], [], []
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                first.append(c != key)
                if c != key:
                    key, best = c, None
                if raw.is_valid:
                    m = np.frombuffer(raw.as_buffer()).reshape(n + 1, n)
                    way = m[n:] if best is None else best[:, None] + m[:n]
                    back.append([-1] * n if best is None else way.argmax(0).tolist())
                    best = way.max(0)
                    best = best - best.max()  # only differences count
                else:
                    back.append(None)
                top.append(None if best is None else int(best.argmax()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(back, pa.list_(pa.int32())), pa.array(top, pa.int32()), pa.array(first, pa.bool_())], names=["c", "part", "back", "top", "first"])

    def backwards(batches):
        key, state = object(), None
        for batch in batches:
            before, last, final = [], [], []
            for c, back, top in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                final.append(c != key)
                if c != key:
                    key, state = c, top
                last.append(state)
                if back is not None and state is not None:
                    state = back[state] if back[state] >= 0 else None
                before.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.int32()), pa.array(last, pa.int32()), batch.column(4), pa.array(final, pa.bool_())], names=["c", "part", "before", "last", "first", "final"])

    small = parts.select("c", "part", "text").mapInArrow(reduce_part, "c long, part long, m binary").repartition("c")
    there = small.sortWithinPartitions("c", "part").mapInArrow(forwards, "c long, part long, back array<int>, top int, first boolean")
    return there.sortWithinPartitions("c", F.col("part").desc()).mapInArrow(backwards, "c long, part long, before int, last int, first boolean, final boolean")


def format_chats(parts: DataFrame, hmm: Hmm) -> DataFrame:
    """Parse and render every transcript (c, part, text); one row per part.

    Result: ``c``, ``part``, ``n_turns`` long and ``roles`` string (comma-joined) of
    the turns that begin in the part, and ``chat`` string: the parts' chats in
    order make the whole one. A transcript without a line has an empty chat.
    """

    def run(batches):
        for batch in batches:
            n, roles, chats = [], [], []
            for text, before, last, first, final in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                turns, goes_on = hmm.parse(text or "", before, last)
                began = turns[1:] if goes_on else turns
                n.append(len(began))
                roles.append(",".join(r for r, _ in began))
                chats.append(render_part(turns, goes_on, before is None, final))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(roles, pa.string()), pa.array(chats, pa.string())], names=["c", "part", "n_turns", "roles", "chat"])

    known = ends(parts, hmm).select(F.col("c").alias("c2"), F.col("part").alias("part2"), "before", "last", "first", "final")
    both = parts.select("c", "part", "text").join(known, F.col("c").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("part2")))
    return both.select("c", "part", "text", "before", "last", "first", "final").mapInArrow(run, "c long, part long, n_turns long, roles string, chat string")
