"""What a session of the assembly stream holds between micro-batches, as typed keyed state.

* ``session``: counts, the highest arrival seen and the last one released, what there is of the states below, and the two rings
  (``poses``, ``depths``) as arrays. Their size is fixed, so this one value has a bound; a micro-batch reads and writes it once.
* ``photos``: time -> (seq, due) of photos that wait for metadata. Never read as a whole but when they leave.
* ``stills``: time -> (sharp, photo) of metadata; ``photo`` is the seq of the photo of that time, once it is there.
* ``waiting``: (seq, kind) -> (time, sharp, at) of arrivals that may still be overtaken.

``stills`` and ``waiting`` are read whole by each micro-batch. They lie in blocks of entries that came together: a
micro-batch adds blocks of what arrived and writes those again from which something left, and never the others.
Each call to a state crosses a socket, which costs more than what it carries, so a state that has nothing is not asked.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from typing import NamedTuple

from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from capturelake.policies import Policy

RING = ("slot int", "number long, timestamp_ns long, seq long")
LAYOUT = {"poses": RING, "depths": RING,
          "photos": ("timestamp_ns long", "seq long, due long"),
          "stills": ("timestamp_ns long", "sharp boolean, photo long"),
          "waiting": ("seq long, kind string", "timestamp_ns long, sharp boolean, at long")}
PROGRESS = "saved int, poses long, depths long, top long, released long"
#: How the same lies in state: rings as arrays from the oldest sample on, maps that are read whole as blocks of entries.
SESSION_STATE = (PROGRESS + "".join(f", {ring}_{c} array<long>" for ring in ("poses", "depths") for c in ("times", "seqs"))
                 + ", still_blocks int, waiting_blocks int, photos_came boolean")
BLOCKED = {name: ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in ", ".join(LAYOUT[name]).split(", ")) for name in ("stills", "waiting")}
BLOCK = 1 << 10
#: Arrivals of one number are handled in this order.
ORDER = {"depth": 0, "pose": 1, "metadata": 2, "image": 3, "end": 4}


class Arrival(NamedTuple):
    seq: int
    kind: str
    ts: int
    sharp: bool
    at: int


class Entries:
    """A map in state with the changes of one micro-batch in front of it."""

    def __init__(self, state=None):
        self.state, self.new, self.gone, self.stored = state, {}, set(), set()
        self.bare: bool | None = None  # whether nothing is stored, once that was asked

    def get(self, key: tuple) -> tuple | None:
        if key in self.new:
            return self.new[key]
        if key in self.gone or self.state is None:
            return None
        value = None if self._bare() else self.state.getValue(key)
        if value is not None:
            self.stored.add(key)
        return value

    def _bare(self) -> bool:
        if self.bare is None:
            self.bare = hasattr(self.state, "exists") and not self.state.exists()
        return self.bare

    def put(self, key: tuple, value: tuple) -> None:
        self.new[key] = value

    def drop(self, key: tuple) -> None:
        if (self.new.pop(key, None) is not None and self.state is not None and key not in self.stored and not self._bare()
                and self.state.containsKey(key)):
            self.stored.add(key)
        self.gone.add(key)

    def all(self) -> dict[tuple, tuple]:
        held = {} if self.state is None else {tuple(k): tuple(v) for k, v in self.state.iterator()}
        self.stored |= held.keys()
        return {k: v for k, v in held.items() if k not in self.gone} | self.new

    def store(self) -> int:
        """Writes the changes; an entry that came and left within the batch is never written."""
        left = self.stored & (self.gone - self.new.keys())
        for key in left:
            self.state.removeKey(key)
        for key, value in self.new.items():
            self.state.updateValue(key, value)
        return len(left) + len(self.new)


class Ring:
    """The newest ``size`` samples in arrival order."""

    def __init__(self, entries: Entries, size: int, number: int):
        self.entries, self.size, self.number = entries, size, number
        self.held = deque((ts, seq) for _, ts, seq in sorted(entries.all().values()))

    def add(self, ts: int, seq: int) -> None:
        self.held.append((ts, seq))
        if len(self.held) > self.size:
            self.held.popleft()
        self.entries.put((self.number % self.size,), (self.number, ts, seq))
        self.number += 1

    def nearest(self, ts: int, tolerance: int) -> tuple:
        """(seq, signed delta) of the nearest held sample, the earlier arrival on ties; nulls if none is near enough."""
        best = min(self.held, key=lambda s: abs(s[0] - ts), default=None)
        return (best[1], best[0] - ts) if best is not None and abs(best[0] - ts) <= tolerance else (None, None)


class Assembly:
    """The alignment of one session. Without a handle nothing is kept, which tests use."""

    def __init__(self, session: str, policy: Policy, lateness: int | None = None, handle: dict | None = None,
                 patience_ms: int | None = None):
        self.session, self.policy, self.lateness, self.patience_ms = session, policy, lateness, patience_ms
        self.with_depth = policy.depth_tolerance_ns is not None
        kept = handle or {}
        self.entries = {name: Entries(kept.get(name)) for name in LAYOUT}
        self.progress = kept.get("progress")
        known = self.progress.get() if self.progress is not None else None
        self.saved, poses, depths, self.top, self.released = known or (0, 0, 0, None, None)
        self.poses = Ring(self.entries["poses"], policy.pose_buffer, poses)
        self.depths = Ring(self.entries["depths"], policy.depth_buffer, depths)
        self.photos = self.entries["photos"]
        self.stills = {k[0]: v for k, v in self.entries["stills"].all().items()}
        self.times = list(self.stills)
        heapify(self.times)
        self.both = [ts for ts, (_, photo) in self.stills.items() if photo is not None]
        heapify(self.both)

    # Arrivals

    def ordered(self, arrivals: Iterable[Arrival]) -> tuple[list[Arrival], list[tuple]]:
        """Arrivals to handle now, in order, and outcome rows of those that come too late.

        With ``lateness`` an arrival waits until one that is so much higher has come. What is not above the last
        number that was released is late, and a repeated (number, kind) that still waits counts once. An ``end``
        releases everything up to its own number.
        """
        rank = lambda a: (a.seq, ORDER[a.kind])
        arrivals = list(arrivals)
        if self.lateness is None or not arrivals:
            return sorted(arrivals, key=rank), []
        waiting, late, behind = self.entries["waiting"], [], self.released
        for a in sorted(arrivals, key=rank):
            if behind is not None and a.seq <= behind:
                late.append((self.session, a.seq, a.ts, "late", None, None, None, None, None))
            elif a.kind != "end":
                waiting.put((a.seq, a.kind), (a.ts, a.sharp, a.at))
        top = max(a.seq for a in arrivals)
        self.top = top if self.top is None else max(self.top, top)
        ends = [a.seq for a in arrivals if a.kind == "end"]
        return self.release(max([self.top - self.lateness, *ends])), late

    def release(self, upto: int | None) -> list[Arrival]:
        """Takes waiting arrivals up to a number out of the buffer, or all."""
        waiting = self.entries["waiting"]
        out = [Arrival(k[0], k[1], *v) for k, v in waiting.all().items() if upto is None or k[0] <= upto]
        for a in out:
            waiting.drop((a.seq, a.kind))
        if upto is not None:
            self.released = upto if self.released is None else max(self.released, upto)
        return sorted(out, key=lambda a: (a.seq, ORDER[a.kind]))

    def handle(self, arrivals: list[Arrival]) -> list[tuple]:
        """Outcome rows of photos that can be finalised after each arrival number."""
        out = []
        for n, a in enumerate(arrivals):
            self.arrive(a)
            if n + 1 == len(arrivals) or arrivals[n + 1].seq != a.seq:
                out.extend(self.finalize())
        return out

    def arrive(self, a: Arrival) -> None:
        if a.kind == "pose":
            self.poses.add(a.ts, a.seq)
        elif a.kind == "depth" and self.with_depth:
            self.depths.add(a.ts, a.seq)
        elif a.kind == "image":
            still = self.stills.get(a.ts)
            if still is None:
                self.photos.put((a.ts,), (a.seq, a.at + (self.patience_ms or 0)))
            else:
                self._pair(a.ts, still[0], a.seq)
        elif a.kind == "metadata":
            still, photo = self.stills.get(a.ts), self.photos.get((a.ts,))
            if photo is not None:
                self.photos.drop((a.ts,))
            seq = photo[0] if photo is not None else still[1] if still is not None else None
            if still is None:
                heappush(self.times, a.ts)
            self._pair(a.ts, a.sharp, seq)
            self._evict(a.at)

    def _pair(self, ts: int, sharp: bool, photo: int | None) -> None:
        self.stills[ts] = (sharp, photo)
        self.entries["stills"].put((ts,), (sharp, photo))
        if photo is not None:
            heappush(self.both, ts)

    def _forget(self, ts: int) -> tuple:
        self.entries["stills"].drop((ts,))
        return self.stills.pop(ts)

    def _evict(self, at: int) -> None:
        """Beyond the buffer, metadata older than every held pose goes; its photo waits on without it."""
        if not self.poses.held or len(self.stills) <= self.policy.metadata_buffer:
            return
        oldest = self.poses.held[0][0] - self.policy.pose_tolerance_ns
        while self.times and self.times[0] < oldest:
            ts = heappop(self.times)
            if ts in self.stills:
                _, photo = self._forget(ts)
                if photo is not None:
                    self.photos.put((ts,), (photo, at + (self.patience_ms or 0)))

    def finalize(self) -> list[tuple]:
        """Outcome rows of the photos that have metadata and a late enough pose; others are not looked at."""
        if not self.poses.held:
            return []
        out, newest, p = [], self.poses.held[-1][0], self.policy
        while self.both and self.both[0] <= newest:
            ts = heappop(self.both)
            if self.stills.get(ts, (None, None))[1] is None:
                continue  # evicted, or finalised already
            sharp, seq = self._forget(ts)
            pose = self.poses.nearest(ts, p.pose_tolerance_ns)
            depth = self.depths.nearest(ts, p.depth_tolerance_ns) if self.with_depth else (None, None)
            outcome = ("rejected_quality" if not sharp else "rejected_pose" if pose[0] is None
                       else "rejected_depth" if self.with_depth and depth[0] is None else "saved")
            self.saved += outcome == "saved"
            out.append((self.session, seq, ts, outcome, *pose, *depth, self.saved if outcome == "saved" else None))
        return out

    # Leaving

    def given_up(self, now: int) -> list[tuple]:
        """Rows of photos whose time to wait for metadata is over; they leave."""
        out = []
        for key, (seq, due) in self.photos.all().items():
            if due <= now:
                self.photos.drop(key)
                out.append((self.session, seq, key[0], "pending_metadata", None, None, None, None, None))
        return out

    def left(self) -> list[tuple]:
        """Rows of everything that waits when the session ends."""
        out = self.handle(self.release(None))
        out += [(self.session, photo, ts, "pending_pose", None, None, None, None, None)
                for ts, (_, photo) in self.stills.items() if photo is not None]
        return out + [(self.session, seq, key[0], "pending_metadata", None, None, None, None, None)
                      for key, (seq, _) in self.photos.all().items()]

    def store(self) -> int:
        """Writes what changed; returns the number of entries written or removed."""
        written = sum(e.store() for e in self.entries.values())
        self.progress.update((self.saved, self.poses.number, self.depths.number, self.top, self.released))
        return written


class PackedRing:
    """A ring as a map, slot -> (arrival number, time, seq), over the two arrays it lies in."""

    def __init__(self, size: int):
        self.size, self.held = size, {}

    def load(self, number: int, times: list, seqs: list) -> None:
        first = number - len(times)
        self.held = {((first + i) % self.size,): (first + i, *sample) for i, sample in enumerate(zip(times, seqs))}

    def packed(self) -> tuple[list, list]:
        held = sorted(self.held.values(), key=lambda s: s[0])[-self.size:]
        return [ts for _, ts, _ in held], [seq for _, _, seq in held]

    def iterator(self) -> Iterable:
        return list(self.held.items())

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.held[key] = value

    def clear(self) -> None:
        self.held = {}


class Blocks:
    """A map that is read whole, over blocks of entries that came together; changes are written by ``flush``."""

    def __init__(self, state, keys: int):
        self.state, self.keys = state, keys
        self.reset()

    def reset(self, count: int = 0) -> None:
        """Of the session whose turn it is, only the number of its blocks is known."""
        self.count, self.held = count, None
        self.place, self.changed, self.added = {}, set(), {}

    def iterator(self) -> Iterable:
        if self.held is None:
            self.held = {}
            for (n,), columns in self.state.iterator() if self.count else ():
                self.held[n] = {tuple(row[:self.keys]): tuple(row[self.keys:]) for row in zip(*columns)}
                self.place |= dict.fromkeys(self.held[n], n)
        return chain.from_iterable(block.items() for block in self.held.values())

    def containsKey(self, key: tuple) -> bool:
        self.iterator()
        return key in self.place

    def getValue(self, key: tuple) -> tuple | None:
        return self.held[self.place[key]][key] if self.containsKey(key) else None

    def updateValue(self, key: tuple, value: tuple) -> None:
        if self.containsKey(key):
            self.held[self.place[key]][key] = value
            self.changed.add(self.place[key])
        else:
            self.added[key] = value

    def removeKey(self, key: tuple) -> None:
        self.iterator()
        n = self.place.pop(key)
        del self.held[n][key]
        self.changed.add(n)

    def clear(self) -> None:
        self.state.clear()
        self.reset()

    def flush(self) -> int:
        """Writes what changed; the number of blocks there are then."""
        held = self.held or {}
        for n in self.changed:
            self._write(n, held[n])
        count = sum(map(bool, held.values())) if self.held is not None else self.count
        last, rows = max(held, default=-1), iter(self.added.items())
        while part := dict(islice(rows, BLOCK)):
            last, count = last + 1, count + 1
            self._write(last, part)
        self.reset()
        return count

    def _write(self, n: int, block: dict[tuple, tuple]) -> None:
        if block:
            self.state.updateValue((n,), tuple(list(c) for c in zip(*[(*k, *v) for k, v in block.items()])))
        else:
            self.state.removeKey((n,))


class Photos:
    """The photos in state, which are not asked before the first one came."""

    def __init__(self, state):
        self.state, self.came = state, False
        self.getValue, self.containsKey, self.removeKey, self.clear = state.getValue, state.containsKey, state.removeKey, state.clear

    def exists(self) -> bool:
        return self.came and self.state.exists()

    def iterator(self) -> Iterable:
        return self.state.iterator() if self.came else ()

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.came = True
        self.state.updateValue(key, value)


class Held:
    """The value ``session``: progress for the assembly, and the rings that lie beside it. ``update`` writes all that changed."""

    def __init__(self, state, rings: list[PackedRing], blocks: list[Blocks], photos: Photos):
        self.state, self.rings, self.blocks, self.photos = state, rings, blocks, photos

    def get(self) -> tuple | None:
        known = self.state.get()
        progress, arrays, counts, came = (known[:5], known[5:9], known[9:11], known[11]) if known is not None else (
            (0, 0, 0, None, None), [[]] * 4, (0, 0), False)
        for ring, number, times, seqs in zip(self.rings, progress[1:3], arrays[::2], arrays[1::2]):
            ring.load(number, times, seqs)
        for b, count in zip(self.blocks, counts):
            b.reset(count)
        self.photos.came = came
        return progress if known is not None else None

    def update(self, progress: tuple) -> None:
        counts = [b.flush() for b in self.blocks]
        self.state.update((*progress, *chain.from_iterable(r.packed() for r in self.rings), *counts, self.photos.came))

    def clear(self) -> None:
        self.state.clear()


def open_state(handle: StatefulProcessorHandle, policy: Policy) -> dict:
    """What ``Assembly`` takes as its handle. Its ``progress`` is read before the others, which show the same session."""
    rings = {"poses": PackedRing(policy.pose_buffer), "depths": PackedRing(policy.depth_buffer or 1)}
    blocks = {name: Blocks(handle.getMapState(name, "block long", columns), LAYOUT[name][0].count(",") + 1) for name, columns in BLOCKED.items()}
    photos = Photos(handle.getMapState("photos", *LAYOUT["photos"]))
    held = Held(handle.getValueState("session", SESSION_STATE), list(rings.values()), list(blocks.values()), photos)
    return {"progress": held, "photos": photos} | rings | blocks


def clear_state(kept: dict) -> None:
    for state in kept.values():
        state.clear()
