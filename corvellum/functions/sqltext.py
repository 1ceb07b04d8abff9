"""Small pieces of SQL that both engines read alike. Literals are cast: Spark reads 1.0 as a decimal."""

from __future__ import annotations

import re


def num(x: float) -> str:
    """A double literal."""
    return f"CAST({x!r} AS DOUBLE)"


def avg_rank(order: str, by: str = "") -> str:
    """Rank from 1 on, ties averaged."""
    part = f"PARTITION BY {by} " if by else ""
    peers = f"PARTITION BY {by}, {order}" if by else f"PARTITION BY {order}"
    return f"(rank() OVER ({part}ORDER BY {order} NULLS LAST) + (count(*) OVER ({peers}) - 1) / CAST(2 AS DOUBLE))"


#: Bins that a column is cut into before it's ranked, so that no one task sorts a whole table.
BINS = 65536


def _binned(relation: str, value: str, by: str, keep: str) -> str:
    """CTEs x and o: the rows of a relation with a bin b of the value, and how many rows lie in lower bins (and their m).

    Bins are equal steps between the least and the greatest value (of a group), so the only window over all of a
    group is one over at most `BINS` + 1 counts; the rows themselves are sorted bin by bin.
    """
    on = f" ON r.{by} = e.{by}" if by else ""
    group = f"{by}, " if by else ""
    join = "JOIN" if by else "CROSS JOIN"
    part = f"PARTITION BY {by} " if by else ""
    return f"""e AS (SELECT {group}CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {relation} WHERE {value} IS NOT NULL{f' GROUP BY {by}' if by else ''}),
x AS (SELECT r.*, CASE WHEN e.hi > e.lo THEN CAST(floor((CAST(r.{value} AS DOUBLE) - e.lo) / (e.hi - e.lo) * {BINS}) AS INT) ELSE 0 END AS b FROM {relation} r {join} e{on} WHERE r.{value} IS NOT NULL),
o AS (SELECT *, sum(n) OVER ({part}ORDER BY b) - n AS before, sum(n) OVER ({part.strip()}) AS m FROM (SELECT {group}b, count(*) AS n{keep} FROM x GROUP BY {group}b) c)"""


def ranked(relation: str, value: str, tie: str, by: str = "", keep: str = "") -> str:
    """CTEs that end in k: the rows of a relation without null values, with their rank i (ties go by another column) and
    the number m of rows, within groups if ``by`` is given. ``keep`` adds aggregates to the table o of bins."""
    join = f"x.b = o.b AND x.{by} = o.{by}" if by else "x.b = o.b"
    part = f"x.{by}, x.b" if by else "x.b"
    return f"""{_binned(relation, value, by, keep)},
k AS (SELECT x.*, CAST(o.before AS BIGINT) + row_number() OVER (PARTITION BY {part} ORDER BY x.{value}, x.{tie}) AS i, CAST(o.m AS BIGINT) AS m FROM x JOIN o ON {join})"""


def tied_ranks(relation: str, value: str, out: str, names: str) -> str:
    """CTEs that end in ``out``: the rows of a relation without null values, with their rank rk, ties averaged. ``names``
    is put before the other CTEs' names, so that a text can hold two."""
    text = f"""{_binned(relation, value, '', '')},
k AS (SELECT x.*, CAST(o.before AS BIGINT) + rank() OVER (PARTITION BY x.b ORDER BY x.{value}) + (count(*) OVER (PARTITION BY x.b, x.{value}) - 1) / CAST(2 AS DOUBLE) AS rk FROM x JOIN o ON x.b = o.b)"""
    for a in ("e", "x", "o"):
        text = re.sub(rf"\b{a} AS \(", f"{names}{a} AS (", text)
        text = re.sub(rf"\b(FROM|JOIN) {a}\b", rf"\1 {names}{a} {a}", text)
    return text.replace("k AS (SELECT x.*", f"{out} AS (SELECT x.*")


def ln_factorial(n: str) -> str:
    """Natural log of n!, by Stirling's series at n + 9, which is exact to about 1e-13, and the factors in between."""
    z = f"(CAST({n} AS DOUBLE) + {num(9)})"
    between = " * ".join(f"(CAST({n} AS DOUBLE) + {num(float(k))})" for k in range(1, 9))
    return f"(({z} - {num(0.5)}) * ln({z}) - {z} + {num(0.9189385332046727)} + {num(1)} / ({num(12)} * {z}) - {num(1)} / ({num(360)} * power({z}, 3)) + {num(1)} / ({num(1260)} * power({z}, 5)) - ln({between}))"


def bin_of_rank(rank: str, n: str, bins: int = 25) -> str:
    """Number from 0 on of the right-closed equal-frequency bin of a rank among n."""
    return f"CAST(greatest(ceil(({rank} - 1) * {num(bins)} / greatest({n} - 1, 1)), 1) - 1 AS INT)"


def clip(x: str, low: float, high: float) -> str:
    """x within bounds."""
    return f"least(greatest({x}, {num(low)}), {num(high)})"


def linear(value: str, scale: str) -> str:
    """A value on the linear scale, from one of the scales counts, linear_tpm, log2tpm, log1p_cp10k."""
    if scale == "log2tpm":
        return f"(power({num(2)}, {value}) - {num(1)})"
    if scale == "log1p_cp10k":
        return f"(exp({value}) - {num(1)})"
    if scale in ("counts", "linear_tpm"):
        return f"CAST({value} AS DOUBLE)"
    raise ValueError(f"no linear scale is known for {scale!r}")


def norm_text(x: str) -> str:
    """An identifier without case, outer space, and with '-' and ' ' as '_'."""
    return f"replace(replace(lower(trim({x})), '-', '_'), ' ', '_')"


def correlation(x: str, y: str) -> str:
    """Pearson correlation, null where a side doesn't vary."""
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), {num(0)}))"


def rounded(x: str, places: int = 6) -> str:
    """x rounded for comparison of engines."""
    return f"round({x}, {places})"
