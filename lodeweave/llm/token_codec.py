"""The range coder of token ids as column functions.

A range coder is one long chain of dependent steps on integers, which neither built-in
functions nor numpy run well, so it is a plain Java function (``TokenCoder.java``, which
states the model and the format).  It is compiled once an application by the compiler that
Spark itself uses for generated code; the jar lies in the shared folder and reaches
executors, new ones included, as any added jar does.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import new_path

SOURCE = Path(__file__).with_name("TokenCoder.java")
#: Ids of a block.
BLOCK = 16384
MAX_ID = (1 << 22) - 1
_FUNCTIONS = {"lodeweave_encode_ids": "Encode", "lodeweave_decode_ids": "Decode"}
#: Function objects by application.
_made: dict[str, dict[str, object]] = {}


def _compile(spark: SparkSession) -> dict[str, object]:
    sc = spark.sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(SOURCE.read_text())
    classes = compiler.getBytecodes()
    jar = io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for name in classes:
            z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
    path = jvm.org.apache.hadoop.fs.Path(new_path(spark, "token-coder") + ".jar")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(jar.getvalue()))
    out.close()
    spark.sql(f"ADD JAR '{path.toString()}'")
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()

    def make(name: str):
        kind = jvm.java.lang.Class.forName(f"lodeweave.codec.TokenCoder${name}", True, loader)
        return kind.getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))

    return {f: make(name) for f, name in _FUNCTIONS.items()}


def _call(name: str, of: Column | str) -> Column:
    spark = SparkSession.active()
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = _compile(spark)
    binary = spark.sparkContext._jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    spark._jsparkSession.udf().register(name, _made[app][name], binary)
    return F.call_function(name, of)


def encode(ids: Column | str) -> Column:
    """Checksummed blocks of BLOCK ids each, for a binary column of little-endian 32-bit ids from 0 to MAX_ID; null stays null."""
    return _call("lodeweave_encode_ids", ids)


def decode(blocks: Column | str) -> Column:
    """The ids of such blocks; a damaged block is an error."""
    return _call("lodeweave_decode_ids", blocks)
