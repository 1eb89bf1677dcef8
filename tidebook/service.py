"""A ledger service over committed tables: submit, read balances, project, advance the time boundary, collect, verify.

One writer at a time. Every step is one commit; a step that dies leaves nothing behind that is read. Per-shard state (at
most 64 rows) lives in the manifest, all else in tables.
"""

from __future__ import annotations

from functools import reduce
from time import sleep

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.config import Settings
from tidebook.operators import history as H
from tidebook.operators import integrity as V
from tidebook.operators import ledger as L
from tidebook.operators import watermark as W
from tidebook.schemas import ledger_type
from tidebook.sources.commits import Store

#: Failures in a row after which projection stops.
FAILURES = 5
FORMAT = {"format": "tidebook-ledger", "schema_version": 1, "routing": "modulo"}
SHARD = "shard_id int, latest_seq long, projected_seq long, boundary_at long, boundary_seq long, gc_prefix_seq long, coverage_seq long"


class Ledger:
    """Opens a ledger at ``root``, with its history at ``history_root``. Other settings than it was made with are refused."""

    def __init__(self, spark: SparkSession, root: str, history_root: str, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.store, self.history = Store(spark, root), Store(spark, history_root)
        self.schema = ledger_type(T.LongType())
        own = {**FORMAT, "shards": self.settings.shards, "history": history_root, "checkpoint": self.settings.checkpoint}
        kept = self.store.manifest()["meta"].get("service")
        if kept is None:
            self.store.commit("open", {}, meta={"service": own, "shards": {}})
        elif kept != own:
            raise ValueError(f"the ledger was made with {kept}, not {own}")
        for shard, x in self._shards().items():
            if not x["gc"] <= min(x["latest"], x["projected"], x["boundary_seq"] or x["gc"]) or x["projected"] > x["latest"] or x["coverage"] > x["latest"]:
                raise ValueError(f"metadata of shard {shard} contradict each other")
        self._check_history()

    def _check_history(self) -> None:
        """Refuse a history that is missing or behind what the ledger says was projected: collected rows are there alone."""
        source = [(k, x["projected"], True) for k, x in self._shards().items() if x["projected"]]
        if not source:
            return
        there = H.progress(self.past()).withColumnRenamed("progress", "destination_progress")
        rows = self.spark.createDataFrame(source, "shard_id int, source_progress long, bound boolean").join(there, "shard_id", "left")
        if bad := H.verified(rows).where("outcome <> 'ok'").orderBy("shard_id").collect():
            raise ValueError(f"history at {self.history.root}: " + ", ".join(f"shard {r['shard_id']} is {r['outcome']}" for r in bad))

    def _shards(self) -> dict[int, dict]:
        blank = {"latest": 0, "projected": 0, "gc": 0, "coverage": 0, "boundary_at": None, "boundary_seq": None}
        kept = self.store.manifest()["meta"]["shards"]
        return {i: blank | kept.get(str(i), {}) for i in range(self.settings.shards)}

    def _commit(self, identity: str, shards: dict[int, dict], append: dict | None = None, replace: dict | None = None, lasting: bool = False) -> None:
        self.store.commit(identity, append or {}, replace, {"shards": {str(k): v for k, v in shards.items()}}, lasting)

    def ledger(self) -> DataFrame:
        return self.store.read("ledger", self.schema)

    def past(self) -> DataFrame:
        return self.history.read("history", self.schema)

    def known(self) -> DataFrame:
        """All results so far: what was collected comes from history."""
        gone = {k: v["gc"] for k, v in self._shards().items() if v["gc"]}
        if not gone:
            return self.ledger()
        old = reduce(lambda a, b: a | b, ((F.col("shard_id") == k) & (F.col("seq") <= v) for k, v in gone.items()))
        return self.ledger().unionByName(self.past().where(old))

    def submit(self, requests: DataFrame, identity: str) -> DataFrame:
        """Replies to ``requests`` (long amounts, a total order in arrival_ord), committed as ``identity``; the same identity
        gives the same replies at any later time. Requests before their shard's boundary are answered from history.

        Only stored rows of the accounts that the requests name are shuffled, and the requests are evaluated once.
        """
        replies = T._parse_datatype_string("identity string, arrival_ord long, reply_kind string, status string, balance long, seq long, shard_id int, replayed boolean, historical_replay boolean")
        if self.store.generation_of(identity) is None:
            state = self._shards()
            rows = L.routed(requests, self.settings.shards)
            boundary = reduce(lambda c, x: c.when(F.col("shard_id") == x[0], F.lit(x[1]["boundary_at"]).cast("long")), state.items(), F.when(F.lit(False), F.lit(None).cast("long")))
            route = F.coalesce(W.route(F.col("transaction_at"), boundary), F.lit("commit"))
            late = W.late_answers(rows.where(route == "historical"), self.past())
            fresh = rows.where(route == "commit").drop("shard_id")
            starts = self.spark.createDataFrame([(k, x["latest"]) for k, x in state.items()], "shard_id int, latest_seq long")
            done = L.applied(fresh, L.touched(self.known(), fresh), self.settings.shards, starts=starts).where("kind <> 'stored'").persist()
            now = L.replies_of(done).withColumn("historical_replay", F.lit(False))
            out = now.select(replies.names[1:]).unionByName(late.withColumn("replayed", F.col("historical_replay")).select(replies.names[1:]))
            new = L.ledger_of(done).select(*self.schema.names)
            due = set()
            for r in new.groupBy("shard_id").agg(F.max("seq").alias("seq")).collect():
                of, q = state[r["shard_id"]], self.settings.checkpoint
                if q and r["seq"] // q > of["latest"] // q:
                    due.add(r["shard_id"])
                of["latest"] = r["seq"]
            replace = {}
            if due:  # a snapshot at the head of each shard that crossed a boundary; the others keep theirs
                replace["snapshot"] = self._snapshot(new, due)
                for shard in due:
                    state[shard]["coverage"] = state[shard]["latest"]
            self._commit(identity, state, {"ledger": new, "replies": out.withColumn("identity", F.lit(identity)).select(*replies.names)}, replace, lasting=True)
            done.unpersist()
        return self.store.read("replies", replies, self.store.generation_of(identity)).where(F.col("identity") == identity).drop("identity")

    def _stored_snapshot(self) -> DataFrame:
        return self.store.read("snapshot", T._parse_datatype_string("shard_id int, account_id long, balance long"))

    def _snapshot(self, new: DataFrame, due: set[int]) -> DataFrame:
        held = self._stored_snapshot()
        tail = self._tail().unionByName(new)
        return V.recovered(held.where(F.col("shard_id").isin(*due)), tail.where(F.col("shard_id").isin(*due))).unionByName(held.where(~F.col("shard_id").isin(*due)))

    def _tail(self) -> DataFrame:
        """Retained rows that the snapshots don't cover."""
        covered = self.spark.createDataFrame([(k, x["coverage"]) for k, x in self._shards().items()], "shard_id int, covered long")
        return self.ledger().join(F.broadcast(covered), "shard_id").where("seq > covered").select(*self.schema.names)

    def balances(self, accounts: DataFrame | None = None) -> DataFrame:
        """Balances of all accounts in order, or of the wanted ones with 0 for unknown ones. With checkpoints they come from
        the snapshots and the rows after them."""
        known = V.recovered(self._stored_snapshot(), self._tail()) if self.settings.checkpoint else L.balances(self.known())
        all_ = known.select("account_id", "balance")
        return all_.orderBy("account_id") if accounts is None else L.balance_of(all_, accounts)

    def project(self) -> int:
        """Bring history up to the ledger in steps of at most ``projection_batch`` rows a shard; how many rows it took.

        A step is taken whole or not at all, and counts once the history acknowledges it: its progress must reach the
        step's end and not pass the head. A step that fails is tried again after 100 ms, twice as long each time up to 1 s;
        after FAILURES in a row the error is raised. Rows that contradict the history are an error at once.
        """
        taken = failures = 0
        while True:
            try:
                n = self._project_step()
            except ValueError:
                raise
            except Exception:
                failures += 1
                if failures == FAILURES:
                    raise
                sleep(min(1.0, 0.1 * 2 ** (failures - 1)))
                continue
            failures, taken = 0, taken + n
            if not n:
                return taken

    def _project_step(self) -> int:
        state, past = self._shards(), self.past()
        ends = {k: min(x["latest"], x["projected"] + self.settings.projection_batch) for k, x in state.items()}
        inside = self.spark.createDataFrame([(k, state[k]["projected"], ends[k]) for k in state], "shard_id int, from_ long, to_ long")
        step = self.ledger().join(F.broadcast(inside), "shard_id").where("seq > from_ and seq <= to_").select(*self.schema.names)
        rows = H.applied_batch(step, past)
        n = rows.count()
        if n:
            if H.findings(rows, past).take(1):
                raise ValueError("the ledger doesn't continue the history")
            self.history.commit(f"up-to-{sorted(ends.items())}", {"history": rows})
        moved = False
        reached = {r["shard_id"]: r["progress"] for r in H.progress(self.past()).collect()}
        for k, x in state.items():
            if ends[k] > x["projected"]:
                if not ends[k] <= reached.get(k, 0) <= x["latest"]:
                    raise ValueError(f"history acknowledges {reached.get(k, 0)} of shard {k}, not {ends[k]} to {x['latest']}")
                x["projected"], moved = ends[k], True
        if moved:
            self._commit(f"projected-{self.store.manifest()['generation']}", state)
        return n

    def _rows(self) -> DataFrame:
        return self.spark.createDataFrame([(k, v["latest"], v["projected"], v["boundary_at"], v["boundary_seq"], v["gc"], v["coverage"] if self.settings.checkpoint else v["latest"]) for k, v in self._shards().items()], SHARD)

    def advance(self, now: int) -> dict[int, int]:
        """Move boundaries up to ``now`` less the retention where the projection covers the head; the boundary of each shard."""
        state = self._shards()
        for r in W.advanced(self._rows(), now, self.settings.retention).collect():
            state[r["shard_id"]] |= {"boundary_at": r["next_at"], "boundary_seq": r["next_seq"]}
        self._commit(f"advanced-{self.store.manifest()['generation']}", state)
        return {k: v["boundary_at"] for k, v in state.items() if v["boundary_at"] is not None}

    def collect(self, most: int | None = None) -> list[dict]:
        """Delete the safe prefix of each shard, up to ``most`` rows; what the step came to, a row a shard that has rows."""
        scanned = W.safe_prefix(self.ledger(), self._rows(), most or self.settings.collection_batch)
        held = H.lookup(scanned.where("deletable").select(*(c for c in self.schema.names if c not in ("status", "balance", "seq"))), self.past())
        if held.where("found <> 'exact_replay'").take(1):
            raise ValueError("history lacks rows that were to be deleted")
        done = [r.asDict() for r in W.accounting(scanned).collect()]
        if any(x["deleted"] for x in done):
            state = self._shards()
            for x in done:
                state[x["shard_id"]]["gc"] = x["prefix"]
            keep = self.ledger().join(scanned.where("deletable").select("shard_id", "seq"), ["shard_id", "seq"], "left_anti").select(*self.schema.names)
            self._commit(f"collected-{self.store.manifest()['generation']}", state, replace={"ledger": keep})
        return done

    def status(self) -> DataFrame:
        return self._rows()

    def verify(self) -> DataFrame:
        """Findings of the retained ledger against the metadata: gaps, rows outside, counts. Empty if all is well."""
        meta = self._rows().select("shard_id", F.col("latest_seq").alias("latest"), F.col("gc_prefix_seq").alias("gc"))
        return V.index_findings(self.ledger(), self.ledger(), meta)
