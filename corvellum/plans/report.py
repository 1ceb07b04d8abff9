"""Reports in Markdown and JSON, over the relational rules of `corvellum.operators.records`."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from corvellum.operators import records as rules
from corvellum.plans.sqlplan import apply
from corvellum.sources import files

# Statuses of a check, and the ratings of a run from the worst on.
STATUSES = ("PASS", "WARN", "FAIL", "INFO")
WORST_FIRST = ("Not reliable until fixed", "Not done", "Accepted despite a failed check", "Usable", "Not applicable", "Good")
ROW = "grp string, check_name string, status string, what string, found string, why string, place int"


def record(check: str, status: str, what: str, found: str, why: str, group: str | None = None) -> dict:
    """A check in plain words; unknown statuses and blank texts are refused."""
    said = {"check": check, "status": status, "what": what, "found": found, "why": why}
    blank = [k for k, v in said.items() if not str(v).strip()]
    if blank or status not in STATUSES:
        raise ValueError(f"a record needs {', '.join(blank)}" if blank else f"unknown status {status!r}")
    return said | ({"group": group} if group else {})


def table(records: Iterable[dict], grp: str = "run") -> DataFrame:
    """Records as rows, in their order."""
    rows = [(grp, r["check"], r["status"], r.get("what"), r.get("found") or r.get("detail"), r.get("why"), i) for i, r in enumerate(records)]
    return SparkSession.active().createDataFrame(rows, ROW)


def rated(stages: Iterable[dict]) -> DataFrame:
    """(grp, rating) of stages given as name, records, accepted and ran; a stage without records wasn't done."""
    spark, stages = SparkSession.active(), list(stages)
    given = spark.createDataFrame([(s["name"], s.get("accepted")) for s in stages], "grp string, accepted string")
    every = spark.createDataFrame([], ROW)
    for s in stages:
        every = every.union(table(s.get("records", []) if s.get("ran", True) else [], s["name"]))
    counts = given.join(apply(rules.status_rollup(), records=every), "grp", "left").fillna(0, ["n_pass", "n_warn", "n_fail", "n_info"])
    return apply(rules.ratings(), rollup=counts)


def overall(records: Iterable[dict]) -> str:
    """The worst status; INFO doesn't count."""
    worst = apply(rules.status_rollup(), records=table(records)).first()
    return worst.overall if worst else "PASS"


def rating(records: list[dict], accepted: str | None = None, ran: bool = True) -> str:
    """What the records amount to."""
    return rated([{"name": "run", "records": records, "accepted": accepted, "ran": ran}]).first().rating


def run_rating(ratings: list[str]) -> str:
    """The worst rating of a run, in its own words."""
    place = lambda r: next(i for i, w in enumerate(WORST_FIRST) if r.startswith(w))
    worst = min(ratings, key=place, default="Good")
    return "Good" if worst == "Not applicable" else worst


def card(title: str, records: list[dict], passes: int = 5, infos: int = 2) -> str:
    """A Markdown table of what matters, the worst first, and how many rows it leaves out."""
    every = table(records)
    shown = apply(rules.card_rows(passes, infos), records=every).select("grp", "check_name", "status", "place")
    rows = every.join(shown, ["grp", "check_name", "status", "place"]).collect()
    rows.sort(key=lambda r: (("FAIL", "WARN", "PASS", "INFO").index(r.status), r.place))
    lines = [f"| {r.check_name} | {r.status} | {r.found or ''} | {r.why or ''} |" for r in rows]
    left = len(records) - len(rows)
    return "\n".join([f"### {title}: {rating(records)}", "", "| check | status | found | why |", "|---|---|---|---|", *lines, *([f"\n{left} more not shown."] if left else [])])


def not_run(records: list[dict], catalogue: dict[str, str]) -> list[str]:
    """Checks of the catalogue that no record is of, by its own name or its group's; in the catalogue's order."""
    if not catalogue:
        return []
    spark = SparkSession.active()
    names = [r["check"] for r in records] + [r["group"] for r in records if r.get("group")]
    seen = spark.createDataFrame([(n,) for n in names], "check_name string")
    listed = spark.createDataFrame(list(catalogue.items()), "check_name string, tests string")
    missing = {r.check_name for r in apply(rules.not_run(), catalogue=listed, records=seen).collect()}
    return [c for c in catalogue if c in missing]


def write_report(spark: SparkSession, records: list[dict], catalogue: dict[str, str], prefix: str, title: str) -> str:
    """``prefix``.md and ``prefix``.json, wherever Spark can write; returns the overall status."""
    missing, worst = not_run(records, catalogue), overall(records)
    counts = {s: sum(r["status"] == s for r in records) for s in STATUSES}
    bad = [f"{r['check']} ({r.get('found') or r.get('detail') or ''})" for s in ("FAIL", "WARN") for r in records if r["status"] == s]
    why = "; ".join(bad) if bad else f"all {counts['PASS']} scored checks passed"
    text = [f"# {title}", "", f"Overall: {worst} ({', '.join(f'{n} {s}' for s, n in counts.items())})", "", f"Why: {why}", "", card(title, records, len(records), len(records))]
    text += ["", "Not run:", *[f"- {c}: {catalogue[c]}" for c in missing]] if missing else []
    files.write_text(spark, f"{prefix}.md", "\n".join(text) + "\n")
    files.write_text(spark, f"{prefix}.json", json.dumps({"overall": worst, "why": why, "counts": counts, "checks": records, "not_run": missing}, indent=1, default=str))
    return worst


def run_summary(entries: list[dict]) -> str:
    """A table of stages (name, records, accepted, ran; optional note and the stage to go back to) and the whole run's rating."""
    ratings = {r.grp: r.rating for r in rated(entries).collect()}
    rows = [f"| {e['name']} | {ratings[e['name']]} | {e.get('note', '')} | {e.get('go_back', '')} |" for e in entries]
    return "\n".join([f"Run: {run_rating(list(ratings.values()))}", "", "| stage | rating | note | go back to |", "|---|---|---|---|", *rows])
