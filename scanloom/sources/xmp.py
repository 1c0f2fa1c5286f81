"""Pose sidecars in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.names import stem
from scanloom.plans.ship import ship_package

# Namespaces of the sidecar format.
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_XCR = "{http://www.capturingreality.com/ns/xcr/1.1#}"

_FIELDS = (
    "path string, rotation array<double>, position array<double>, fl35 double, ppu double, ppv double, error string"
)


def _parse(content: bytes) -> tuple:
    """Pose fields of one sidecar, or the reason it is rejected."""
    from xml.etree import ElementTree

    try:
        description = next(ElementTree.fromstring(content).iter(f"{_RDF}Description"), None)
        if description is None:
            return None, None, None, None, None, "no description"
        numbers = {}
        for tag, size in (("Rotation", 9), ("Position", 3)):
            text = description.findtext(f"{_XCR}{tag}")
            if text is None:
                return None, None, None, None, None, f"no {tag.lower()}"
            numbers[tag] = [float(t) for t in text.split()]
            if len(numbers[tag]) < size:
                return None, None, None, None, None, f"short {tag.lower()}"
        scalars = [
            float(description.get(f"{_XCR}{a}", 0)) for a in ("FocalLength35mm", "PrincipalPointU", "PrincipalPointV")
        ]
        return numbers["Rotation"], numbers["Position"], *scalars, None
    except (ElementTree.ParseError, ValueError) as e:
        return None, None, None, None, None, str(e)


def read_xmp(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``.xmp`` file: ``stem, rotation, position, fl35, ppu, ppv, error``.

    Missing attributes are 0. A malformed or incomplete sidecar keeps its row, with
    nulls and the reason in ``error``.
    """
    ship_package(spark)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.xmp")
        .load(path)
        .select("path", "content")
    )

    parse = _parse

    def rows(batches):
        import pandas as pd

        names = [f.split()[0] for f in _FIELDS.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(p, *parse(bytes(c))) for p, c in zip(batch["path"], batch["content"])], columns=names)

    parsed = files.mapInPandas(rows, _FIELDS)
    return parsed.select("path", stem(F.col("path")).alias("stem"), *[f.split()[0] for f in _FIELDS.split(", ")[1:]])
