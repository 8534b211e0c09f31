"""The cheapest repair of one sequence of turns: cost DP, then path ranking by prefix doubling.

A turn is kept, given another role or deleted, and turns are inserted, so that the roles read ``(s?(ua)+)?``. Four states say what
stands before a place: nothing, the system turn, a user turn, an assistant turn. A state allows one role to be given or inserted,
and at most one role to be kept, so the arcs that leave a node (place, state) have different letters.

The DP runs backwards over vectors of costs to go, one per state. Less their minimum, only few different vectors occur, so a
step is looked up by (vector, kind of turn). The arcs that attain the least costs form a graph of nodes. Nodes are ranked by the
first 1, 2, 4, ... letters of their least audit: a rank pairs the node's rank with that of the node its pointer reaches, and the
pointer is doubled. The ranks choose among a node's arcs, and the bits of an offset lead through the doubled pointers to the node
at that place of the audit. All sequences of a batch are ranked together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a given or inserted turn, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Classes of initials, and the state after keeping one, by state before.
CLASSES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
KEEPS = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
FINE, TRUNCATED, DELETED = range(3)
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
LETTERS = "DIKR"
FAR = 1 << 40  # more than any cost
#: Costs to go where a conversation ends.
END = (0, INSERT + INSERT, INSERT, 0)


def _kinds(cls: np.ndarray, fault: np.ndarray) -> np.ndarray:
    return cls * 3 + fault


class _Steps:
    """Looked-up DP steps. Arcs are held as (letter, moved to the next place, state), three for every state at most."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.known: dict[tuple[int, int], int] = {}
        self.before: list[int] = []
        self.less: list[int] = []
        self.arcs: list[list[list[tuple]]] = []

    def vector(self, costs) -> tuple[int, int]:
        least = min(costs)
        key = tuple(min(c - least, FAR) for c in costs)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], least

    def step(self, after: int, kind: int) -> int:
        found = self.known.get((after, kind))
        if found is not None:
            return found
        cls, fault = divmod(kind, 3)
        later, extra = self.vectors[after], CUT * (fault == TRUNCATED)
        moves = []
        for state in range(4):
            arcs = [(DELETE + later[state], "D", 1, state)]
            if fault != DELETED:
                if state in KEEPS[cls]:
                    arcs.append((extra + later[KEEPS[cls][state]], "K", 1, KEEPS[cls][state]))
                arcs.append((REROLE + extra + later[NEXT[state]], "R", 1, NEXT[state]))
            moves.append(arcs)
        costs = [min(arcs)[0] for arcs in moves]
        for _ in range(3):  # at most three inserted turns lie between two states
            costs = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
        for state in range(4):
            moves[state].append((INSERT + costs[NEXT[state]], "I", 0, NEXT[state]))
        best = [sorted((LETTERS.index(l) + 1, m, to) for c, l, m, to in moves[s] if c == costs[s]) for s in range(4)]
        before, less = self.vector(costs)
        self.known[after, kind] = number = len(self.before)
        self.before.append(before)
        self.less.append(less)
        self.arcs.append(best)
        return number

    def table(self) -> np.ndarray:
        """(step, state, arc, [letter, move, state]); letter 9 where there is no further arc."""
        table = np.zeros((len(self.arcs), 4, 3, 3), dtype="int64")
        table[..., 0] = 9
        for number, states in enumerate(self.arcs):
            for state, arcs in enumerate(states):
                for k, arc in enumerate(arcs):
                    table[number, state, k] = arc
        return table


@dataclass
class Paths:
    """Least paths of all runs, one after another: per letter its code (index in LETTERS), run, turn and the state before it."""

    letter: np.ndarray
    run: np.ndarray
    turn: np.ndarray
    state: np.ndarray
    cost: list[int]
    exits: np.ndarray  # state at the end of each run's path


def least_paths(cls: np.ndarray, fault: np.ndarray, lengths: np.ndarray, ends=None, entries: np.ndarray | None = None) -> Paths:
    """The cheapest edits with the ASCII-least audit for runs of turns that lie one after another.

    ``lengths``: turns per run. ``ends``: costs to go at the end of each run; None where the conversation ends there. ``entries``:
    the state before each run, START by default. ``turn`` of a letter is the turn it edits or, for an insertion, the one that follows.
    """
    runs = len(lengths)
    steps = _Steps()
    kinds = _kinds(cls, fault).tolist()
    entries = np.zeros(runs, dtype="int64") if entries is None else entries
    numbers = [0] * len(kinds)
    cost = [0] * runs
    place = len(kinds)
    for run in range(runs - 1, -1, -1):
        end = END if ends is None or ends[run] is None else ends[run]
        vector, total = steps.vector(end)
        first = place - int(lengths[run])
        for i in range(place - 1, first - 1, -1):
            number = steps.known.get((vector, kinds[i]))
            if number is None:
                number = steps.step(vector, kinds[i])
            numbers[i] = number
            total += steps.less[number]
            vector = steps.before[number]
        place = first
        cost[run] = total + steps.vectors[vector][entries[run]]

    # Nodes: four states for every turn and for the end of every run. A place is a turn's index plus the runs before it.
    run_of = np.repeat(np.arange(runs), lengths)
    n_places = len(kinds) + runs
    at = np.arange(len(kinds)) + run_of
    last = np.cumsum(lengths + 1) - 1
    letters = np.full((n_places, 4, 3), 9, dtype="int64")
    targets = np.broadcast_to(np.arange(n_places * 4).reshape(n_places, 4, 1), (n_places, 4, 3)).copy()
    if len(kinds):
        arcs = steps.table()[np.array(numbers)]
        letters[at] = arcs[..., 0]
        targets[at] = np.where(arcs[..., 0] < 9, (at[:, None, None] + arcs[..., 1]) * 4 + arcs[..., 2], targets[at])
    closed = np.array([ends is None or ends[run] is None for run in range(runs)], dtype=bool)
    for state in (SYSTEM, USER):  # where the conversation ends, an open exchange is completed
        letters[last[closed], state, 0] = LETTERS.index("I") + 1
        targets[last[closed], state, 0] = last[closed] * 4 + NEXT[state]
    letters, targets = letters.reshape(-1, 3), targets.reshape(-1, 3)
    letters[letters[:, 0] == 9, 0] = 0  # the end of a path comes before any letter

    nodes = np.arange(n_places * 4)
    pointer, rank = targets[:, 0], letters[:, 0]
    length = (rank > 0).astype("int64")
    doubled = [pointer]
    while True:
        moved = doubled[-1]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[moved], return_inverse=True)[1]
        length = length + length[moved]
        if (moved[moved] == moved).all():
            break
        doubled.append(moved[moved])
    choice = np.argmin(letters * (len(nodes) + 1) + rank[targets], axis=1)
    letter = letters[nodes, choice]

    begin = (np.cumsum(lengths + 1) - lengths - 1) * 4 + entries
    size = length[begin]
    run = np.repeat(np.arange(runs), size)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    node = np.repeat(begin, size)
    for k, moved in enumerate(doubled):
        node = np.where(offset >> k & 1, moved[node], node)
    return Paths(letter[node] - 1, run, node // 4 - run, node % 4, cost, doubled[-1][begin] % 4)


def span_costs(cls: np.ndarray, fault: np.ndarray) -> list[int]:
    """Least costs from each state before a run to each state at its end, as a row-major 4 x 4 table; FAR and more: no path."""
    table = [[0] * 4 for _ in range(4)]
    for end in range(4):
        goal = [FAR * (state != end) for state in range(4)]
        for state in range(4):
            table[state][end] = least_costs(cls, fault, goal, state)
    return [c for row in table for c in row]


def least_costs(cls: np.ndarray, fault: np.ndarray, end, state: int) -> int:
    steps = _Steps()
    vector, total = steps.vector(end)
    for kind in _kinds(cls, fault).tolist()[::-1]:
        number = steps.step(vector, kind)
        total += steps.less[number]
        vector = steps.before[number]
    return total + steps.vectors[vector][state]


def roles_of(paths: Paths, roles: list[str]) -> list[str | None]:
    """The role of the turn that each letter leaves; None for a deleted one."""
    given = [ROLES[s] for s in NEXT]
    out: list[str | None] = []
    for code, turn, state in zip(paths.letter.tolist(), paths.turn.tolist(), paths.state.tolist()):
        letter = LETTERS[code]
        out.append(None if letter == "D" else roles[turn] if letter == "K" else given[state])
    return out
