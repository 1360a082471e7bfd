"""Import and export of the binary folder format: ``map<i>.tsv``, ``<name>_<arity>_<rows>.rel``, ``.ceg``, ``rules.hyp``, ``supplementary.cst``.

Relations are rows of little-endian 32-bit numbers; the maps give each number's name, in
hexadecimal.

A relation that is kept by groups has a row for each pair, too, as other readers of the format need it.  With ``by_groups`` it has
``<name>.<part>.grp`` (value, group) and ``<name>.<part>.lnk`` (group, group, 1 for off + 2 for diag) instead, of the same numbers;
parts are ``facts``, or ``rest`` and ``mirror`` of a half.  The reader takes either.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compress import CompressedKb
from ..operators.grouped import Grouped, Halved
from ..operators.kb import KbError, KnowledgeBase, counted, cut_lineage, numbered, union
from ..plans.rule import parse_rule
from . import binary

#: Files that are planned or written side by side.
FILES_AT_ONCE = 4

_REL = re.compile(r"(?P<name>.+)_(?P<arity>\d+)_(?P<rows>\d+)\.rel\Z")


def file_name(name: str, arity: int, rows: int) -> str:
    return f"{name}_{arity}_{rows}.rel"


def parse_file_name(path: str) -> tuple[str, int, int]:
    m = _REL.match(PurePosixPath(path).name)
    if not m:
        raise KbError(f"{path} is no relation file")
    return m["name"], int(m["arity"]), int(m["rows"])


def encode_ints(values) -> bytes:
    return np.asarray(list(values), "<i4").tobytes()


def decode_ints(data: bytes, arity: int) -> np.ndarray:
    """Rows of ``arity`` numbers; a row that is cut short is left out."""
    found = np.frombuffer(data[: len(data) // 4 * 4], "<i4")
    return found[: len(found) // arity * arity].reshape(-1, arity)


def read_map(spark: SparkSession, folder: str) -> DataFrame:
    """``name, num`` of all map files."""
    rows = spark.read.csv(f"{folder}/map*.tsv", sep="\t", schema="name string, hex string", quote="")
    return rows.select("name", F.conv("hex", 16, 10).cast("long").alias("num"))


def _numbers(spark: SparkSession, path: str, arity: int) -> DataFrame:
    return binary.read_rows(spark, path, arity)


def _threads(spark: SparkSession) -> ThreadPoolExecutor:
    """Threads in which the session is the active one, as Spark looks up a Python data source there."""
    return ThreadPoolExecutor(FILES_AT_ONCE, initializer=lambda: spark.createDataFrame([], "x int"))


def _checked(numbers: list[DataFrame], names: DataFrame) -> None:
    """One job for all files: every number has a name."""
    cells = union(df.select(F.explode(F.array(*df.columns)).alias("num")) for df in numbers).distinct()
    if cells.join(names, "num", "left_anti").limit(1).count():
        raise KbError("a number is not in the map")


def _loaded(spark: SparkSession, files: list[tuple[str, int]], names: DataFrame, check: bool) -> list[DataFrame]:
    """Relations of symbols; files are planned side by side."""
    with _threads(spark) as pool:
        numbers = list(pool.map(lambda f: _numbers(spark, *f), files))
    if check and numbers:
        _checked(numbers, names)
    return [KnowledgeBase(spark).decoded(df, names) for df in numbers]


def _files(spark: SparkSession, folder: str, glob: str) -> list[str]:
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return sorted(unquote(r["path"]) for r in found.collect())  # names of relation files


def read_folder(spark: SparkSession, folder: str, name: str = "kb", check: bool = True) -> KnowledgeBase:
    kb = KnowledgeBase(spark, name)
    found = [(path, *parse_file_name(path)[:2]) for path in _files(spark, folder, "*.rel")]
    frames = _loaded(spark, [(path, arity) for path, _, arity in found], read_map(spark, folder), check)
    for (_, relation, _), df in zip(found, frames, strict=True):
        kb.attach(relation, df)
    for relation, parts in _read_groups(spark, folder, check).items():
        kb.attach_grouped(relation, parts["facts"] if "facts" in parts else Halved(**parts))
    return kb


def _read_groups(spark: SparkSession, folder: str, check: bool) -> dict[str, dict[str, Grouped]]:
    """The parts of relations that were written by groups."""
    out: dict[str, dict[str, Grouped]] = {}
    paths = _files(spark, folder, "*.grp")
    names = read_map(spark, folder) if paths else None
    for path in paths:
        relation, part = PurePosixPath(path).stem.rsplit(".", 1)
        groups, links = _numbers(spark, path, 2), _numbers(spark, f"{path.removesuffix('.grp')}.lnk", 3)
        if check:
            _checked([groups.select("c0")], names)
        values = groups.join(names, groups["c0"] == names["num"]).select(F.col("name").alias("val"), F.col("c1").cast("string").alias("grp"))
        flag = lambda n: F.col("c2").bitwiseAND(F.lit(n)) != 0
        ends = links.select(F.col("c0").cast("string").alias("s"), F.col("c1").cast("string").alias("t"), flag(1).alias("off"), flag(2).alias("diag"))
        out.setdefault(relation, {})[part] = Grouped(values, ends).written()
    return out


def _write_groups(facts: Grouped, path: str, numbers: DataFrame) -> None:
    """The two files of a part; groups are numbered, too."""
    spark = numbers.sparkSession
    facts = facts.written()
    ids = cut_lineage(numbered(facts.groups.select("grp").distinct(), "grp", "id"))
    of = lambda c, number: ids.select(F.col("grp").alias(c), F.col("id").alias(number))
    values = facts.groups.join(numbers.withColumnRenamed("name", "val"), "val").join(ids, "grp").select(F.col("num").alias("c0"), F.col("id").alias("c1"))
    _write_numbers(spark, f"{path}.grp", values)
    flags = F.col("off").cast("long") + 2 * F.col("diag").cast("long")
    _write_numbers(spark, f"{path}.lnk", facts.links.join(of("s", "c0"), "s").join(of("t", "c1"), "t").select("c0", "c1", flags.alias("c2")))


def read_compressed(spark: SparkSession, folder: str, arities: dict[str, int], check: bool = True) -> CompressedKb:
    """Necessary facts, counterexamples, rules and supplementary symbols; arities of relations come from the original."""
    kept = read_folder(spark, folder, "necessary", check)
    wrong = [(path, PurePosixPath(path).stem) for path in _files(spark, folder, "*.ceg")]
    cst = _files(spark, folder, "supplementary.cst")
    frames = _loaded(spark, [(path, arities[n]) for path, n in wrong] + [(path, 1) for path in cst], read_map(spark, folder), check)
    rules = [parse_rule(r["value"]) for r in spark.read.text(f"{folder}/rules.hyp").collect() if r["value"].strip()]
    more = frames.pop().select(F.col("c0").alias("val")) if cst else spark.createDataFrame([], "val string")
    return CompressedKb(None, rules, kept, {n: df for (_, n), df in zip(wrong, frames, strict=True)}, more)


def _write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any file system that Spark knows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _write_numbers(spark: SparkSession, path: str, numbers: DataFrame) -> None:
    """One file; its parts are written, and put together, by tasks."""
    folder, name = path.rsplit("/", 1)
    parts = f"{folder}/_parts-{name}"  # beside the target, as parts are moved or copied within one file system
    binary.joined(spark, parts, binary.write_parts(numbers, parts), path)
    binary.dropped(spark, parts)


def _write_map(numbers: DataFrame, folder: str) -> None:
    """A map file for each partition."""
    spark, parts = numbers.sparkSession, f"{folder}/_parts-map"
    lines = numbers.select(F.concat_ws("\t", "name", F.lower(F.hex("num"))))
    binary.placed(spark, parts, binary.write_parts(lines, parts, lines=True), f"{folder}/map{{}}.tsv")
    binary.dropped(spark, parts)


def write_folder(kb: KnowledgeBase, folder: str, numbers: DataFrame | None = None, by_groups: bool = False) -> None:
    """Maps and relation files, one for each relation as the format asks; see :mod:`.binary` for how tasks write one file.

    With ``by_groups`` relations that are kept by groups are written as groups and links.
    """
    numbers = cut_lineage(kb.numeration()) if numbers is None else numbers
    _write_map(numbers, folder)
    rows = kb.sizes()
    held = [n for n in kb.names if by_groups and rows[n] and (n in kb.grouped or n in kb.halved)]
    _write_all(kb, {n: f"{folder}/{file_name(n, kb.arity(n), rows[n])}" for n in kb.names if rows[n] and n not in held}, numbers)
    for n in held:
        known = kb.grouped.get(n) or kb.halved[n]
        parts = {"facts": known} if n in kb.grouped else {"rest": known.rest, "mirror": known.mirror}
        for part, facts in parts.items():
            _write_groups(facts, f"{folder}/{n}.{part}", numbers)


def _write_all(kb: KnowledgeBase, paths: dict[str, str], numbers: DataFrame) -> None:
    """Some files at a time: each is a few small jobs, which leave most of a cluster idle."""
    with _threads(kb.spark) as pool:
        list(pool.map(lambda n: _write_numbers(kb.spark, paths[n], kb.encoded(n, numbers)), paths))


def write_compressed(result: CompressedKb, folder: str, by_groups: bool = False) -> None:
    """A compressed knowledge base in the binary format; parts that are empty have no file.  For ``by_groups`` see :func:`write_folder`."""
    kept, spark = result.necessary, result.necessary.spark
    names = result.symbols().select(F.col("val").alias("name")).unionByName(spark.createDataFrame([(n,) for n in kept.names], "name string")).distinct()
    numbers = cut_lineage(numbered(names, "name", "num"))
    write_folder(kept, folder, numbers, by_groups)
    if result.rules:
        _write_file(spark, f"{folder}/rules.hyp", "".join(f"{r}\n" for r in result.rules).encode())
    wrong = KnowledgeBase(spark, "counterexamples")
    for name, df in result.counterexamples.items():
        wrong.attach(name, df, known_set=True)
    _write_all(wrong, {name: f"{folder}/{name}.ceg" for name, n in counted(wrong.frames).items() if n}, numbers)
    more = KnowledgeBase(spark).attach("supplementary", result.supplementary.select("val"), known_set=True)
    if counted(more.frames)["supplementary"]:
        _write_all(more, {"supplementary": f"{folder}/supplementary.cst"}, numbers)
