"""Pose algebra on scalar columns, so that every formula stays in generated code.

A pose with prefix ``P`` is twelve columns: ``P_r00`` ... ``P_r22`` and ``P_t0``,
``P_t1``, ``P_t2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUAT = ("qw", "qx", "qy", "qz")
_TVEC = ("tx", "ty", "tz")


def pose_columns(prefix: str) -> list[str]:
    return [f"{prefix}_r{i}{j}" for i in range(3) for j in range(3)] + [f"{prefix}_t{i}" for i in range(3)]


def unpack_pose(df: DataFrame) -> DataFrame:
    """Scalar quaternion and translation columns from the arrays ``qvec`` and ``tvec``."""
    cols = {q: F.col("qvec")[i] for i, q in enumerate(_QUAT)}
    cols.update({t: F.col("tvec")[i] for i, t in enumerate(_TVEC)})
    return df.withColumns(cols)


def quat_to_rot(df: DataFrame, prefix: str = "rot") -> DataFrame:
    """Rotation matrix of the quaternion (w, x, y, z), which is not normalised."""
    axes = ("qx", "qy", "qz")
    out = {}
    for i in range(3):
        for j in range(3):
            if i == j:
                a, b = (axes[m] for m in range(3) if m != i)
                out[f"{prefix}_r{i}{j}"] = F.expr(f"1 - 2 * ({a}*{a} + {b}*{b})")
            else:
                third = 3 - i - j
                sign = "-" if (j - i) % 3 == 1 else "+"
                out[f"{prefix}_r{i}{j}"] = F.expr(f"2 * ({axes[i]}*{axes[j]} {sign} {axes[third]}*qw)")
    return df.withColumns(out)


def w2c(df: DataFrame, prefix: str = "w2c") -> DataFrame:
    """World-to-camera pose [R | t] from quaternion and translation columns."""
    out = quat_to_rot(df, prefix)
    return out.withColumns({f"{prefix}_t{i}": F.col(t).cast("double") for i, t in enumerate(_TVEC)})


def invert_rigid(df: DataFrame, source: str = "w2c", target: str = "c2w") -> DataFrame:
    """Inverse of a rigid pose: transposed rotation, and translation -R^T t."""
    out = {f"{target}_r{i}{j}": F.col(f"{source}_r{j}{i}") for i in range(3) for j in range(3)}
    for i in range(3):
        terms = " + ".join(f"{source}_r{k}{i} * {source}_t{k}" for k in range(3))
        out[f"{target}_t{i}"] = F.expr(f"-({terms})")
    return df.withColumns(out)


def flip_yz(df: DataFrame, prefix: str = "c2w") -> DataFrame:
    """Negate the second and third rotation columns: switch between the two camera axis conventions."""
    return df.withColumns({f"{prefix}_r{i}{j}": -F.col(f"{prefix}_r{i}{j}") for i in range(3) for j in (1, 2)})


def model_to_c2w(df: DataFrame, prefix: str = "c2w", flip: bool = True) -> DataFrame:
    """Camera-to-world pose of a model image: rotation, rigid inverse, axis flip."""
    out = invert_rigid(w2c(df, "_w"), "_w", prefix).drop(*pose_columns("_w"))
    return flip_yz(out, prefix) if flip else out


def xmp_to_c2w(df: DataFrame, prefix: str = "c2w", flip: bool = True) -> DataFrame:
    """Camera-to-world pose of a sidecar: row-major ``rotation`` and ``position`` as given."""
    out = {f"{prefix}_r{i}{j}": F.col("rotation")[3 * i + j] for i in range(3) for j in range(3)}
    out.update({f"{prefix}_t{i}": F.col("position")[i] for i in range(3)})
    posed = df.withColumns(out)
    return flip_yz(posed, prefix) if flip else posed


def transform_point(prefix: str, x: str, y: str, z: str) -> list[Column]:
    """The three coordinates of pose * (x, y, z)."""
    return [
        F.expr(f"{prefix}_r{i}0 * ({x}) + {prefix}_r{i}1 * ({y}) + {prefix}_r{i}2 * ({z}) + {prefix}_t{i}")
        for i in range(3)
    ]


def pose_matrix(prefix: str = "c2w") -> Column:
    """The pose as a 4 x 4 array of arrays."""
    rows = [", ".join([*(f"{prefix}_r{i}{j}" for j in range(3)), f"{prefix}_t{i}"]) for i in range(3)]
    return F.expr("array(" + ", ".join(f"array({r})" for r in rows) + ", array(0D, 0D, 0D, 1D))")


def from_matrix(df: DataFrame, matrix: str, prefix: str = "c2w") -> DataFrame:
    """Scalar pose columns from a 4 x 4 array column."""
    out = {f"{prefix}_r{i}{j}": F.col(matrix)[i][j] for i in range(3) for j in range(3)}
    out.update({f"{prefix}_t{i}": F.col(matrix)[i][3] for i in range(3)})
    return df.withColumns(out)


def invert_pose(df: DataFrame, matrix: str, name: str = "inverse", rigid: bool = False) -> DataFrame:
    """Inverse of a 4 x 4 matrix column, by cofactors; a singular one gives null."""
    if rigid:
        out = invert_rigid(from_matrix(df, matrix, "_a"), "_a", "_b")
        return out.withColumn(name, pose_matrix("_b")).drop(*pose_columns("_a"), *pose_columns("_b"))

    m = [[F.col(matrix)[i][j].cast("double") for j in range(4)] for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    # Determinants of column pairs: of the two upper rows, and of the two lower ones.
    upper = {(i, j): m[0][i] * m[1][j] - m[0][j] * m[1][i] for i, j in pairs}
    lower = {(i, j): m[2][i] * m[3][j] - m[2][j] * m[3][i] for i, j in pairs}
    names = {f"_u{i}{j}": upper[i, j] for i, j in pairs} | {f"_l{i}{j}": lower[i, j] for i, j in pairs}
    cells = df.withColumns(names)
    rest = {p: tuple(sorted({0, 1, 2, 3} - set(p))) for p in pairs}
    sign = {p: (-1) ** (p[0] + p[1] + 1) for p in pairs}
    det = sum((F.col(f"_u{i}{j}") * F.col("_l{}{}".format(*rest[i, j])) * sign[i, j] for i, j in pairs), F.lit(0.0))

    def minor(row: int, col: int) -> Column:
        """Determinant without ``row`` and ``col``: the other row of its half, by pairs of the other half."""
        kept = [c for c in range(4) if c != col]
        other, half = (1 - row, "_l") if row < 2 else (5 - row, "_u")
        terms = [m[other][c] * F.col(half + "".join(str(x) for x in kept if x != c)) for c in kept]
        return terms[0] - terms[1] + terms[2]

    rows = [F.array(*[minor(j, i) * (-1) ** (i + j) / F.col("_det") for j in range(4)]) for i in range(4)]
    solved = cells.withColumn("_det", det).withColumn(name, F.when(F.abs("_det") > 0, F.array(*rows)))
    return solved.drop("_det", *names)
