"""The trees on the JVM: Java sources beside this file, compiled once by the driver and handed to the executors as a jar.

Where there is no Java compiler, or a tree has what the sources lack, the Python
trees run instead; they give the same rows.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from functools import lru_cache

from py4j.java_gateway import JavaClass
from pyspark.sql import DataFrame, SparkSession

from ..operators.splits import SPLITS

_KINDS = {"rtree": 0, "rstar": 1, "hilbert": 2, "overflow": 3}
_DESIGNS = {"fast": 1, "cold": 2, "tuned": 3}
_POLICIES = {"all": 0, "random": 1, "most": 2, "most_and_oldest": 3, "value": 4, "cold": 5}
_VALUES = {"height": 1, "area": 2, "overlap": 3}
_READS = {"LRU": 0, "HLRU": 1, "S2Q": 2, "2Q": 3}
#: Bits of a Hilbert value's coordinates that a long holds.
_MOST_BITS = 31


@lru_cache(maxsize=1)
def _jar() -> str | None:
    """The compiled sources, for as long as this process lives; none without a compiler."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jvm = spark.sparkContext._jvm
    compiler = jvm.com.sun.tools.javac.Main
    if not isinstance(compiler, JavaClass):  # a runtime without the compiler's module
        return None
    here, out = os.path.dirname(os.path.abspath(__file__)), tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, out, True)
    sources = [os.path.join(here, f) for f in sorted(os.listdir(here)) if f.endswith(".java")]
    words = ["-proc:none", "-nowarn", "--release", "17", "-cp", jvm.java.lang.System.getProperty("java.class.path"), "-d", out, *sources]
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.String, len(words))
    for i, w in enumerate(words):
        args[i] = w
    if compiler.compile(args):
        raise RuntimeError("the Java sources of the trees do not compile")
    jar = os.path.join(out, "gridloom-trees.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for folder, _, files in os.walk(out):
            for f in files:
                if f.endswith(".class"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), out))
    return jar


_ADDED: dict[str, object] = {}


def _loader(spark: SparkSession):
    """A class loader with the jar, which the application's executors have too; none without a compiler."""
    app = spark.sparkContext.applicationId
    if app not in _ADDED:
        jar = _jar()
        if jar is not None:
            spark.sparkContext._jsc.addJar(jar)
            jvm = spark.sparkContext._jvm
            urls = spark.sparkContext._gateway.new_array(jvm.java.net.URL, 1)
            urls[0] = jvm.java.io.File(jar).toURI().toURL()
            jar = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        _ADDED[app] = jar
    return _ADDED[app]


def _numbers(tree) -> list | None:
    """What makes a tree (of operators.trees.make_tree), as the sources read it; none if they don't have it."""
    kind = next((k for k in _KINDS if type(tree).__name__ == {"rtree": "RTree", "rstar": "RStarTree", "hilbert": "HilbertTree", "overflow": "OverflowTree"}[k]), None)
    split = next((i for i, f in enumerate(SPLITS.values()) if f is tree.split_by), None)
    bits = getattr(tree, "bits", 1)
    if kind is None or split is None or bits > _MOST_BITS or not 1 <= tree.least <= (tree.most + 1) // 2:
        return None
    g = lambda name, other: getattr(tree, name, other)
    out = [_KINDS[kind], split, tree.least, tree.most, float(g("share", 0.0)), int(g("far", False)), g("neighbours", 0), g("order", 0), *map(float, g("domain", (0.0,) * 4)), bits, float(g("ratio", 0.0)), g("overflow", 0)]
    store = g("store", None)
    if store is None:
        return out + [0] * 13
    c, reads = store.writes.config, store.reads
    main = fresh = 0
    if reads is not None:
        b = reads.read_buffer
        main, fresh = (b.main.capacity, b.room) if reads.policy == "2Q" else (b.capacity, 0)
    return out + [
        _DESIGNS[store.design], _POLICIES[c.policy], _VALUES.get(c.value, 0), int(c.control), c.unit_pages, c.capacity, c.node_bytes, float(c.oldest), float(c.warm),
        _READS[reads.policy] if reads is not None else 0, main, fresh, c.seed,
    ]


def run(ordered: DataFrame, made: dict[int, object], mode: str, more: dict[int, list], schema: str) -> DataFrame | None:
    """What a mode makes of each index's operations (ordered, an index in one partition); made: a tree of each. None if the Python trees must do it."""
    each = {i: _numbers(t) for i, t in made.items()}
    spark = ordered.sparkSession
    if None in each.values() or not hasattr(spark, "_jvm"):
        return None
    loader = _loader(spark)
    if loader is None:
        return None
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    lines = "\n".join(" ".join(map(str, [i, *n, *more.get(i, [])])) for i, n in each.items())
    types, values = gateway.new_array(jvm.java.lang.Class, 2), gateway.new_array(jvm.java.lang.Object, 2)
    for k, text in enumerate((mode, lines)):
        types[k], values[k] = jvm.java.lang.Class.forName("java.lang.String"), text
    task = loader.loadClass("gridloom.Trees").getConstructor(types).newInstance(values)
    encoder = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(schema))
    return DataFrame(ordered._jdf.mapPartitions(task, encoder), spark)
