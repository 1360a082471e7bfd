"""Beam search for rules of one relation."""

from __future__ import annotations

import heapq
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.scores import Eval, Metric, evaluation
from ..plans.rule import Rule, start_rule
from .candidates import Level, Seen, admitted, domain_sizes, generalisations, specialisations
from .evaluate import evaluate, scored
from .kb import KnowledgeBase
from .monitor import Monitor
from .profile import promising_constants, similar_columns, value_counts


@dataclass
class MinerConfig:
    beam: int = 3
    fact_coverage: float = 0.05
    constant_coverage: float = 0.25
    strict_constants: bool = False
    column_similarity: float = 0.0
    stop_ratio: float = 0.9
    metric: Metric = Metric.CAPACITY
    generalise: bool = False
    most_rules: int | None = None
    threads: int = 4
    observe: bool = False
    specialise: Callable = field(default=specialisations, repr=False)

    def __post_init__(self) -> None:
        if self.beam < 1 or self.threads < 1:
            raise ValueError("the beam has one rule at least, the search one thread")
        self.stop_ratio = max(0.5, self.stop_ratio)


class Interrupted(Exception):
    """The search was asked to stop; what it found so far stands."""


@contextmanager
def stoppable(spark: SparkSession, stop: Callable[[], bool], every: float = 0.5) -> Iterator[None]:
    """Cancels the jobs that this thread runs within, and no others, once ``stop`` says so; what they were for raises :class:`Interrupted`."""
    sc, tag, done = spark.sparkContext, f"factweave-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not done.wait(every):
            if stop():
                sc.cancelJobsWithTag(tag)  # again and again, as a level is several jobs

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if stop():
            raise Interrupted from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)


#: Facts that a task of a small search takes, and the most of a knowledge base that is searched in such tasks.
SMALL_TASK, SMALL_BASE = 100_000, 10_000_000


def small_session(spark: SparkSession, facts: int) -> SparkSession:
    """A session for searches of so many facts; the given one if they are many.

    A level is hundreds of small stages.  Of few facts, planning them again after each stage and shuffling by the tasks of a
    large table takes nearly all of the time, so stages are planned once, with as many tasks as the facts need.
    """
    if facts > SMALL_BASE:
        return spark
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", str(-(-facts // SMALL_TASK) or 1))
    return own


class Miner:
    """Searches rules of any relation of one knowledge base; it marks what they entail there."""

    def __init__(self, kb: KnowledgeBase, config: MinerConfig | None = None, stop: Callable[[], bool] = lambda: False, steps: Monitor | None = None):
        self.kb, self.config, self.stop, self.steps = kb, config or MinerConfig(), stop, steps or Monitor()
        self.lock = threading.Lock()
        # one table of values by column serves everything that is needed of the knowledge base as a whole
        self.values = value_counts(kb).persist()
        self.domains = self.values.select("rel", "pos", "val")
        self.sizes, self.totals = {}, {}
        for r in self.values.groupBy("rel", "pos").agg(F.count("*").alias("different"), F.sum("n").alias("all")).collect():  # columns of the catalogue
            self.sizes[(r["rel"], r["pos"])], self.totals[r["rel"]] = r["different"], r["all"]
        self.symbols = self.values.select("val").distinct().count()
        self.level = Level(kb, self.domains, self.sizes, self.symbols)
        self.constants: dict[tuple[str, int], list[str]] = {}
        # at most 1 / coverage constants for each column
        for r in promising_constants(kb, self.config.constant_coverage, self.config.strict_constants, self.values).collect():
            self.constants.setdefault((r["rel"], r["pos"]), []).append(r["val"])
        for values in self.constants.values():
            values.sort()
        self.similar = lambda a, b: True
        if self.config.column_similarity > 0:
            found = {frozenset([(r["rel1"], r["pos1"]), (r["rel2"], r["pos2"])]) for r in similar_columns(kb, self.config.column_similarity, self.values).collect()}
            self.similar = lambda a, b: a == b or frozenset([a, b]) in found
        self.observed: list = []
        self.monitor = {"duplicate": 0, "invalid": 0, "tabu": 0, "low_coverage": 0, "evaluated": 0, "rounds": 0}

    def close(self) -> None:
        self.level.close()
        self.values.unpersist()

    def order(self, item: tuple[Rule, Eval]) -> tuple:
        """Better first: score, then shorter, then by text."""
        rule, e = item
        return (-e.value(self.config.metric), rule.length, str(rule))

    def children(self, beams: list[tuple[Rule, Eval]], seen: Seen) -> list[tuple[Rule, Eval]]:
        """Refinements of a whole level that score better than their parents; one job counts them all."""
        c = self.config
        work = [(rule, admitted(c.specialise(rule, self.kb.arities, self.constants, self.similar), seen)) for rule, _ in beams]
        out = []
        for (rule, parent), (_, found), counts in zip(beams, work, self.level.count(work), strict=True):
            total = self.totals.get(rule.head.relation, 0)
            for x, n in zip(found, counts, strict=True):
                if not total or n.new / total <= c.fact_coverage:
                    seen.covered_less += 1
                    seen.tabu.add(x.rule)
                    continue
                seen.evaluated += 1
                out.append((x.rule, evaluation(float(n.new), n.all - n.old, x.rule.length, parent), parent))
        if c.generalise:
            wider = {str(r): (r, parent) for rule, parent in beams for r in generalisations(rule) if not r.invalid()}
            for row in scored(self.kb, [r for r, _ in wider.values()]).collect() if wider else []:
                r, parent = wider[row["rule"]]
                out.append((r, evaluation(row["pos"], row["all"], r.length, parent), parent))
        return [(r, e) for r, e, parent in out if e.value(c.metric) > parent.value(c.metric)]

    def find_rule(self, relation: str, seen: Seen) -> tuple[Rule, Eval] | None:
        """The best rule that a beam search meets, if it is useful.

        A search that is stopped, between levels or within one, gives the best rule of the last whole level.
        """
        c, first = self.config, start_rule(relation, self.kb.arity(relation))
        if self.stop():
            raise Interrupted
        with stoppable(self.kb.spark, self.stop):
            beams = [(first, evaluate(self.kb, first, self.symbols))]
        while True:
            with self.lock:
                self.monitor["rounds"] += 1
            best_now = min(beams, key=self.order)
            try:
                if self.stop():
                    raise Interrupted
                with stoppable(self.kb.spark, self.stop), self.steps.step("level", relation) as now:
                    before = seen.evaluated + seen.covered_less
                    level = self.children(beams, seen)
                    now.rows_in, now.rows_out = seen.evaluated + seen.covered_less - before, len(level)
            except Interrupted:
                if best_now[1].useful:
                    return best_now
                raise
            if not level:
                return best_now if best_now[1].useful else None
            level = heapq.nsmallest(c.beam, level, key=self.order)
            best = level[0]
            if self.order(best_now)[0] <= self.order(best)[0]:
                return best_now if best_now[1].useful else None
            if (best[1].tau >= c.stop_ratio or best[1].neg == 0) and best[1].useful:
                return best
            beams = level

    def count(self, seen: Seen) -> None:
        """Adds what a search met to the totals; searches run side by side."""
        with self.lock:
            self.observed += seen.observed or []
            met = {"duplicate": seen.duplicate, "invalid": seen.invalid, "low_coverage": seen.covered_less, "evaluated": seen.evaluated, "tabu": seen.tabu.hits}
            for name, n in met.items():
                self.monitor[name] += n
            seen.duplicate = seen.invalid = seen.covered_less = seen.evaluated = seen.tabu.hits = 0
