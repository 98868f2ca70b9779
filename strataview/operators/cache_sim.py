"""Cache policy simulation per node: admission, S3-FIFO eviction, ghosts, size classes.

The policy is sequential within a node; nodes never share state and run in
parallel. Reads are sorted in stretches of time by many tasks, packed, brought
together by node, and streamed through the simulation in Arrow batches: a task
sorts parcels of a few bytes a read, and holds one batch and the state of one
node, which the cache's capacity bounds, whatever the trace's length.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Bits of a filter for each member it is made for, and bits a member sets.
BITS_EACH, SET_EACH = 10, 7
SPREAD = 0x9E3779B97F4A7C15


class Doorkeeper:
    """Which blocks were refused of late: two generations of ``window`` refusals
    each, as bit tables; filling the younger one discards the elder. So a
    refusal is remembered for one to two windows, with few false memories."""

    def __init__(self, window: int):
        self.window, self.size = window, -(-window * BITS_EACH // 64) * 64
        self.tables = deque([self._blank(), self._blank()], maxlen=2)  # elder, younger
        self.left = window

    def _blank(self) -> bytearray:
        return bytearray(self.size // 8)

    def _spots(self, h: int) -> list[tuple[int, int]]:
        """Bytes and bits of a member: steps of an odd stride from its hash."""
        stride = (h << 32 | h >> 32) * SPREAD & MASK | 1
        return [divmod((h + k * stride & MASK) % self.size, 8) for k in range(SET_EACH)]

    def __contains__(self, h: int) -> bool:
        spots = self._spots(h)
        return any(all(table[byte] >> bit & 1 for byte, bit in spots) for table in self.tables)

    def insert(self, h: int) -> None:
        if not self.left:
            self.tables.append(self._blank())
            self.left = self.window
        self.left -= 1
        for byte, bit in self._spots(h):
            self.tables[-1][byte] |= 1 << bit


@dataclass
class Block:
    size: int
    extent: int
    key: int
    freq: int = 0
    queue: str = "small"
    seq: int = 0
    stays: bool = True  # whether the node owns it after the ring's change


@dataclass
class Store:
    """Slots of power-of-two classes in equal extents; eviction by S3-FIFO.

    A tenth of the capacity is the small queue's target. A block leaving the
    small queue unread goes to the ghost list, whose length is at most the
    number of blocks held (the leaving one included); one that returns while
    remembered starts in the main queue.
    """

    extent_size: int
    extents: int
    least_slot: int
    most_slot: int
    blocks: dict[int, Block] = field(default_factory=dict)
    small: deque = field(default_factory=deque)
    main: deque = field(default_factory=deque)
    ghost: deque = field(default_factory=deque)
    ghosts: dict[int, int] = field(default_factory=dict)
    small_bytes: int = 0
    seq: int = 0
    evicted: int = 0
    log: list[int] = field(default_factory=list)
    disowned: deque = field(default_factory=deque)
    disowned_dropped: int = 0

    def __post_init__(self):
        self.free_extents = list(range(self.extents - 1, -1, -1))
        self.space: dict[int, dict[int, int]] = {}  # class -> extent -> free slots
        self.members: dict[int, set[int]] = {e: set() for e in range(self.extents)}
        self.class_of: dict[int, int] = {}

    def slot(self, length: int) -> int:
        return min(max(1 << (length - 1).bit_length(), self.least_slot), self.most_slot)

    def _take(self, size: int) -> int | None:
        room = self.space.get(size)
        if not room:
            return None
        e = min(room)
        room[e] -= 1
        if not room[e]:
            del room[e]
        return e

    def _give(self, b: Block) -> None:
        e = b.extent
        self.members[e].discard(b.key)
        if self.members[e]:
            room = self.space.setdefault(b.size, {})
            room[e] = room.get(e, 0) + 1
        else:
            self.space.get(b.size, {}).pop(e, None)
            self.class_of.pop(e, None)
            self.free_extents.append(e)

    def _drop(self, key: int) -> Block:
        b = self.blocks.pop(key)
        if b.queue == "small":
            self.small_bytes -= b.size
        self._give(b)
        self.evicted += 1
        self.log.append(key)
        return b

    def _remember(self, h: int) -> None:
        self.ghost.append(h)
        self.ghosts[h] = self.ghosts.get(h, 0) + 1
        while len(self.ghost) > max(len(self.blocks), 1):
            old = self.ghost.popleft()
            self.ghosts[old] -= 1
            if not self.ghosts[old]:
                del self.ghosts[old]

    def disown(self, owned: Callable[[Block], bool]) -> None:
        """Mark the blocks that a changed ring gives to other nodes: they go
        first. A mark holds for the entry it was made on, not for a later one
        of the same block; a new call replaces all marks."""
        self.disowned = deque((k, b.seq) for k, b in self.blocks.items() if not owned(b))

    def evict_one(self) -> int | None:
        while self.disowned:
            key, seq = self.disowned.popleft()
            if key in self.blocks and self.blocks[key].seq == seq:
                self.disowned_dropped += 1
                return self._drop(key).extent
        target = self.extent_size * self.extents // 10
        while self.small or self.main:
            from_small = self.small_bytes > target if self.main else True
            if from_small and not self.small:
                from_small = False
            key, seq = (self.small if from_small else self.main).popleft()
            b = self.blocks.get(key)
            if b is None or b.seq != seq or b.queue != ("small" if from_small else "main"):
                continue
            if from_small:
                if b.freq:
                    self.small_bytes -= b.size
                    b.freq, b.queue = 0, "main"
                    self.main.append((key, seq))
                    continue
                self._remember(key)
            elif b.freq:
                b.freq -= 1
                self.main.append((key, seq))
                continue
            return self._drop(key).extent
        return None

    def fill(self, key: int, length: int) -> bool:
        """Reserve a slot and put the block in its queue."""
        size, tries, victims, emptied = self.slot(length), 0, [], False
        while (e := self._take(size)) is None:
            if self.free_extents:
                x = self.free_extents.pop()
                self.class_of[x] = size
                self.space.setdefault(size, {})[x] = self.extent_size // size
            elif tries < 8:
                tries += 1
                v = self.evict_one()
                if v is None:
                    return False
                victims.append(v)
            elif emptied:
                return False
            else:
                used = [v for v in reversed(victims) if v in self.class_of]
                idle = used[0] if used else min(self.class_of, key=lambda x: (len(self.members[x]), x), default=None)
                if idle is None:
                    return False
                for k in sorted(self.members[idle]):
                    self._drop(k)
                emptied = True
        self.seq += 1
        remembered = key in self.ghosts
        self.blocks[key] = Block(size, e, key, 0, "main" if remembered else "small", self.seq)
        self.members[e].add(key)
        (self.main if remembered else self.small).append((key, self.seq))
        if not remembered:
            self.small_bytes += size
        return True

    def hit(self, key: int) -> bool:
        b = self.blocks.get(key)
        if b is None:
            return False
        b.freq = min(b.freq + 1, 3)
        return True

    def usage(self) -> dict[int, tuple[int, int]]:
        """Extents and blocks of each class."""
        out: dict[int, list[int]] = {}
        for e, size in self.class_of.items():
            u = out.setdefault(size, [0, 0])
            u[0] += 1
            u[1] += len(self.members[e])
        return {k: (v[0], v[1]) for k, v in out.items()}


@dataclass
class NodeSim:
    """One node: store, doorkeeper, and its counters. ``budget`` bounds the
    bytes on their way into the store; :meth:`filled` says that they are in."""

    store: Store
    doorkeeper: Doorkeeper | None
    counts: OrderedDict = field(default_factory=OrderedDict)
    budget: int | None = None
    filling: int = 0

    def add(self, name: str, n: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + n

    def read(self, key: int, length: int, owned: bool = True, unwritten: bool = False, passes: bool = False, missed: bool = True) -> str:
        """``hit``, or what admission makes of the fetched block: ``none`` (the
        node neither owns nor leases it, or readers hold a failed write of it;
        not counted), ``doorkeeper``, ``budget``, ``full`` or ``stored``.
        ``passes``: peer-supplied, leased, prefetched, metadata or admitted on
        first read, so no doorkeeper. Without ``missed`` no miss is counted."""
        if self.store.hit(key):
            self.add("hits")
            self.add("hit_bytes", length)
            return "hit"
        self.add("fetched")
        self.add("fetched_bytes", length)
        if not owned or unwritten:
            return "none"
        known = self.doorkeeper is not None and key in self.doorkeeper
        refused = self.doorkeeper is not None and not passes and not known
        self.add("miss_evicted" if key in self.store.ghosts else "miss_unadmitted" if known else "miss_new", int(missed))
        if refused:
            self.doorkeeper.insert(key)
            outcome = "doorkeeper"
        elif self.budget is not None and self.filling + length > self.budget:
            outcome = "budget"
        elif self.store.fill(key, length):
            outcome = "stored"
            self.filling += length
            self.add("written_bytes", length)
        else:
            outcome = "full"
        self.add(NAMES[outcome], int(missed))
        return outcome

    def filled(self) -> None:
        self.filling = 0


#: Counters of admission outcomes.
NAMES = {"doorkeeper": "refused", "budget": "over_budget", "full": "full", "stored": "stored"}
COUNTERS = ["hits", "hit_bytes", "fetched", "fetched_bytes", "miss_new", "miss_unadmitted", "miss_evicted", "refused", "over_budget", "stored", "full", "written_bytes", "evicted", "disowned"]


def by_runs(batches: Iterator, key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """(key values, rows) from batches sorted by ``key``, batch by batch: rows
    of one key come in as many portions as batches hold them."""
    for b in batches:
        rows, at = b.to_pylist(), 0
        while at < len(rows):
            k = tuple(rows[at][c] for c in key)
            end = at
            while end < len(rows) and tuple(rows[end][c] for c in key) == k:
                end += 1
            yield k, rows[at:end]
            at = end


#: Milliseconds whose rows are sorted together, and rows of a parcel: Python gets up to 10,000 parcels at once.
STRETCH, PARCEL_ROWS = 3_600_000, 512


def parcels(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` in parcels: ``key``, ``__at`` and ``__seq``, by which parcels of
    a key are in the order of ``order``, and ``__rows``, up to PARCEL_ROWS rows
    of ``columns`` as a compressed Arrow batch.

    Rows of a key and a stretch of time (``order[0]``, in milliseconds) are
    sorted apart from all others, so a key of any length is sorted by many
    tasks; what follows sorts parcels, a few bytes a row."""
    at = rows.withColumn("__at", F.floor(F.col(order[0]) / STRETCH))
    names = [*key, "__at"]

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def parcel(some) -> bytes:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(some)
            return sink.getvalue().to_pybytes()

        seq = 0
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.array([False] * (b.num_rows - 1), pa.bool_())
            for c in (b.column(n) for n in names):
                x, y = c.slice(1), c.slice(0, b.num_rows - 1)
                new = pc.or_(new, pc.coalesce(pc.not_equal(x, y), pc.not_equal(pc.is_null(x), pc.is_null(y))))
            starts = [0, *(pc.indices_nonzero(new).to_numpy() + 1).tolist(), b.num_rows]
            cuts = [(i, min(i + PARCEL_ROWS, end)) for first, end in zip(starts, starts[1:], strict=False) for i in range(first, end, PARCEL_ROWS)]
            kept = b.select(columns)
            blobs = [parcel(kept.slice(i, end - i)) for i, end in cuts]
            heads = b.select(names).take(pa.array([i for i, _ in cuts], pa.int64()))
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(range(seq, seq + len(cuts)), pa.int64()), pa.array(blobs, pa.binary())], names=[*names, "__seq", "__rows"])
            seq += len(cuts)

    schema = ", ".join(f"{n} {kind}" for n, kind in at.select(*names).dtypes) + ", __seq long, __rows binary"
    return at.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(pack, schema)


def streamed(rows: DataFrame, key: list[str], order: list[str], columns: list[str], schema: str, start: Callable, step: Callable, finish: Callable, few: bool = False) -> DataFrame:
    """A fold over each key's rows in order. ``start(key)`` makes a state,
    ``step(state, row)`` returns rows to give at once (or None), ``finish(state)``
    the last ones. A task holds one batch and one state. ``few`` keys of many
    rows each (nodes) go in :func:`parcels`; ``step`` sees ``columns`` and the
    first of ``order``, a time in milliseconds."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = schema_of(schema)
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        now, state = None, None
        for k, some in unpacked(batches) if few else by_runs(batches, key):
            out = []
            if k != now:
                if now is not None:
                    out += finish(state) or []
                now, state = k, start(k)
            for r in some:
                out += step(state, r) or []
            if out:
                yield batch(out)
        if now is not None and (out := finish(state)):
            yield batch(out)

    def unpacked(batches: Iterator) -> Iterator[tuple[tuple, list[dict]]]:
        import pyarrow as pa

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
            for k, raw in zip(keys, b.column("__rows"), strict=True):
                yield k, pa.ipc.open_stream(raw.as_buffer()).read_all().to_pylist()

    wanted = rows.select(*dict.fromkeys([*key, *order, *columns]))
    if few:
        packed = parcels(wanted, key, order, list(dict.fromkeys([order[0], *columns])))
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, or small parcels of all keys would be put in one task
        return packed.repartition(n, *key).sortWithinPartitions(*key, "__at", "__seq").mapInArrow(run, schema)
    return wanted.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def schema_of(schema: str) -> list:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    return [kinds[f.strip().split()[1]] for f in schema.split(",")]


def summary(node: int, sim: NodeSim) -> list[tuple]:
    sim.counts["evicted"] = sim.store.evicted - sim.store.disowned_dropped
    sim.counts["disowned"] = sim.store.disowned_dropped
    rows = [(node, c, int(sim.counts.get(c, 0))) for c in COUNTERS]
    for size, (e, b) in sorted(sim.store.usage().items()):
        rows += [(node, f"class_{size}_extents", e), (node, f"class_{size}_blocks", b)]
    return rows


def simulate(reads: DataFrame, node: str, order: list[str], key: str, length: str, extent_size: int, extents: int, least_slot: int, most_slot: int, window: int | None, owned: str | None = None, unwritten: str | None = None, passes: str | None = None, stays: str | None = None, change_at: int | None = None, budget: int | None = None) -> DataFrame:
    """Counters and class usage of each node: ``node, name, value``. ``key`` is
    a 64-bit block hash. ``owned``, ``unwritten`` and ``passes`` name boolean
    columns of :meth:`NodeSim.read`. The first column of ``order`` is the time:
    at ``change_at`` the ring changes, and blocks whose ``stays`` is false are
    disowned. With ``budget`` fills of one time share it."""

    def start(k: tuple):
        return {"node": int(k[0]), "sim": NodeSim(Store(extent_size, extents, least_slot, most_slot), Doorkeeper(window) if window else None, budget=budget), "at": None}

    def step(state: dict, r: dict) -> None:
        sim, now = state["sim"], r[order[0]]
        if change_at is not None and state["at"] is not None and state["at"] < change_at <= now:
            sim.store.disown(lambda b: b.stays)
        if now != state["at"]:
            state["at"] = now
            sim.filled()
        if sim.read(r[key] & MASK, r[length], owned is None or r[owned], unwritten is not None and r[unwritten], passes is not None and r[passes]) == "stored" and stays:
            sim.store.blocks[r[key] & MASK].stays = r[stays]

    columns = [c for c in (key, length, owned, unwritten, passes, stays) if c]
    return streamed(reads, [node], order, columns, "node long, name string, value long", start, step, lambda s: summary(s["node"], s["sim"]), few=True)


def leases(reads: DataFrame, keys: list[str], ts_ms: str, order: list[str], window_ms: int, threshold: int, lease_ms: int) -> DataFrame:
    """Grants of hot-key leases, with windows that start at a placement's first
    read: when ``threshold`` reads fall in one, a lease begins, and reads under
    it do not count. One row a lease."""

    def step(s: dict, r: dict) -> list[tuple]:
        now, out = r[ts_ms], []
        if s["lease"] and s["lease"][1] <= now:
            out, s["lease"] = [(*s["key"], *s["lease"])], None
        if s["lease"]:
            s["lease"][2] += 1
            return out
        if s["window"] is None or s["window"] + window_ms <= now:
            s["window"], s["count"] = now, 0
        s["count"] += 1
        if s["count"] >= threshold:
            s["window"], s["lease"] = None, [now, now + lease_ms, 0]
        return out

    start = lambda k: {"key": k, "window": None, "count": 0, "lease": None}
    return streamed(reads, keys, order, [ts_ms], _keys_schema(reads, keys) + ", lease_start long, lease_end long, leased_reads long", start, step, lambda s: [(*s["key"], *s["lease"])] if s["lease"] else [])


def _keys_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {({'bigint': 'long'}).get(kinds[k], kinds[k])}" for k in keys)


def lease_renewals(reads: DataFrame, keys: list[str], ts_ms: str, order: list[str], window_ms: int, threshold: int, lease_ms: int, replicas: int = 2) -> DataFrame:
    """Leases as :func:`leases` grants them, and what becomes of them. One row
    a lease, ``renewed`` if it goes on from one before.

    Reads under a lease are dealt to the owner and its replicas in turn.
    Replicas report theirs at half of the lease; at three quarters the owner
    renews a lease whose rate, its own reads since the grant and the replicas'
    in their half, is at least half of that which made the key hot.
    """
    half, quarter = lease_ms // 2, lease_ms // 4
    schema = _keys_schema(reads, keys) + ", lease_start long, lease_end long, leased_reads long, reported_reads long, renewed boolean"

    def start(k: tuple) -> dict:
        return {"key": k, "window": None, "count": 0, "lease": None}

    def close(s: dict) -> list[tuple]:
        x, s["lease"] = s["lease"], None
        return [(*s["key"], x["from"], x["until"], x["reads"], x["reported"], x["renewed"])]

    def renew(s: dict, now: int) -> list[tuple]:
        """Decide leases whose time for it has come by ``now``."""
        out = []
        while (x := s["lease"]) and x["decided"] <= now:
            period, told = max(x["decided"] - x["from"], 1), max(half, 1)
            busy = (x["own"] * told + x["reported"] * period) * window_ms * 2 >= threshold * period * told
            if not busy:
                x["decided"] = x["until"] + 1  # runs out
                break
            else:
                at = x["decided"]
                x["until"] = at
                out += close(s)
                s["lease"] = fresh(at, True)
        if s["lease"] and s["lease"]["until"] <= now:
            out += close(s)
        return out

    def fresh(at: int, renewed: bool) -> dict:
        return {"from": at, "until": at + lease_ms, "decided": at + lease_ms - quarter, "reads": 0, "own": 0, "reported": 0, "renewed": renewed}

    def step(s: dict, r: dict) -> list[tuple]:
        now = r[ts_ms]
        out = renew(s, now)
        if x := s["lease"]:
            x["reads"] += 1
            if x["reads"] % (replicas + 1) == 1 or not replicas:
                x["own"] += 1
            elif now < x["from"] + half:
                x["reported"] += 1
            return out
        if s["window"] is None or s["window"] + window_ms <= now:
            s["window"], s["count"] = now, 0
        s["count"] += 1
        if s["count"] >= threshold:
            s["window"], s["lease"] = None, fresh(now, False)
        return out

    def finish(s: dict) -> list[tuple]:
        return close(s) if s["lease"] else []

    return streamed(reads, keys, order, [ts_ms], schema, start, step, finish)


def recency(reads: DataFrame, node: str, order: list[str], key: str, capacity: int, emit: list[str]) -> DataFrame:
    """A least-recently-used set of ``capacity`` keys a node: for each read
    ``hit``, and the key it ``evicts`` (null: none)."""
    schema = ", ".join([*(f"{c} long" for c in emit), "hit boolean", "evicts long"])

    def step(held: OrderedDict, r: dict) -> list[tuple]:
        k, out = r[key], None
        hit = k in held
        held[k] = None
        held.move_to_end(k)
        if len(held) > capacity:
            out = held.popitem(last=False)[0]
        return [(*(r[c] for c in emit), hit, out)]

    return streamed(reads, [node], order, [key, *emit], schema, lambda _: OrderedDict(), step, lambda _: [], few=True)


def looked_up(requests: DataFrame, values: DataFrame, key: str, order: list[str], ts: str, value: str, ttl: int, emit: list[str]) -> DataFrame:
    """A lookup join with a time to live: a key's value is asked for at its
    first request and kept for ``ttl``; the next request after that asks again
    and sees the value of then. ``values``: ``key``, ``since``, ``value``
    (long), the history of the dimension. Gives ``emit``, ``value`` and
    ``asked``, the time the value was fetched."""
    side = values.select(key, F.col("since").alias(ts), F.col(value).alias("__v"), F.lit(0).alias("__side"), *[F.lit(None).cast("long").alias(c) for c in dict.fromkeys([*order, *emit]) if c not in (key, ts)])
    lines = requests.select(*dict.fromkeys([key, ts, *order, *emit])).withColumn("__v", F.lit(None).cast("long")).withColumn("__side", F.lit(1)).unionByName(side)

    def step(s: dict, r: dict) -> list[tuple] | None:
        if not r["__side"]:
            s["now"] = r["__v"]
            return None
        if s["asked"] is None or r[ts] >= s["asked"] + ttl:
            s["asked"], s["held"] = r[ts], s["now"]
        return [(*(r[c] for c in emit), s["held"], s["asked"])]

    schema = ", ".join([*(f"{c} long" for c in emit), "value long", "asked long"])
    start = lambda _: {"now": None, "held": None, "asked": None}
    return streamed(lines, [key], [ts, "__side", *[c for c in order if c != ts]], ["__v", *emit], schema, start, step, lambda _: [])
