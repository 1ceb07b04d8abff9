"""Rules for plotting scripts, over {scripts}(path string, text string), and defaults for figures.

A script is parsed where it lies into facts: its calls, their keywords and literal arguments, the names and the texts in it,
each with its line. Comments aren't facts, and a word in a text is no call. Rules are then conditions on the facts of a script, as
DataFrame expressions; a rule names what breaks it and, where it has any, what excuses it.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours and maps that figures should use, by what they show, those they must not use, and the least letter size.
PALETTES = {"sequential": "Blues", "density": "Greys", "diverging": "RdBu_r", "categorical": ("#0072B2", "#D55E00", "#009E73", "#CC79A7", "#E69F00", "#4D4D4D")}
RAINBOWS = ("jet", "rainbow", "hsv", "gist_rainbow", "nipy_spectral", "gist_ncar", "turbo")
NEON = ("cyan", "aqua", "yellow", "lime", "magenta", "fuchsia", "#00ffff", "#ffff00", "#00ff00", "#ff00ff", "#0ff", "#ff0", "#0f0", "#f0f")
LEAST_SIZE = 8.0

PLOTS = ("plot", "bar", "barh", "scatter", "hist", "errorbar", "imshow", "pie", "boxplot", "violinplot")
FACT = ("kind", "owner", "name", "part", "value", "number", "line")
_FACT = "array<struct<kind:string,owner:string,name:string,part:string,value:string,number:double,line:int>>"


# ---- facts of a script --------------------------------------------------------------------------------------------


def _named(node: ast.AST) -> tuple[str, str]:
    """(what it belongs to, its own name) of a name or attribute: ("np.random", "normal")."""
    if isinstance(node, ast.Attribute):
        owner, name = _named(node.value)
        return f"{owner}.{name}".strip("."), node.attr
    return ("", node.id) if isinstance(node, ast.Name) else ("", "")


def _literal(node: ast.AST) -> tuple[str | None, float | None]:
    """Text and number of a literal; a name stands for its last part."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        _, number = _literal(node.operand)
        return None, None if number is None else -number
    if isinstance(node, ast.Constant):
        value = node.value
        is_number = isinstance(value, int | float) and not isinstance(value, bool)
        return (None if value is None else str(value)), (float(value) if is_number else None)
    return _named(node)[1] or None, None


def facts(text: str) -> list[tuple]:
    """(kind, owner, name, part, value, number, line) of calls, keywords, literal arguments, names and texts; notebook commands
    (% and ! lines) are passed over. What can't be parsed is one fact of the kind "broken"."""
    source = re.sub(r"(?m)^\s*[%!].*$", "", text)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("broken", "", type(e).__name__, "", None, None, getattr(e, "lineno", None))]
    out = []
    for node in ast.walk(tree):
        line = getattr(node, "lineno", None)
        if isinstance(node, ast.Call):
            owner, name = _named(node.func)
            out.append(("call", owner, name, "", None, float(len(node.args)), line))
            out += [("argument", owner, name, str(i), *_literal(a), line) for i, a in enumerate(node.args)]
            out += [("keyword", owner, name, k.arg or "**", *_literal(k.value), k.value.lineno) for k in node.keywords]
        elif isinstance(node, ast.Attribute | ast.Name):
            owner, name = _named(node)
            out.append(("name", owner, name, "", None, None, line))
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            out.append(("text", "", "", "", node.value, None, line))
        elif isinstance(node, ast.Assign):
            out += [("set", "", t.id, "", *_literal(node.value), line) for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.alias):
            out.append(("name", "", node.name.rsplit(".", 1)[-1], "", None, None, line))
    return sorted(out, key=lambda f: (f[6] or 0, f[0], f[2], f[3]))


# ---- rules --------------------------------------------------------------------------------------------------------


def _call(*names: str):
    return lambda f: (f["kind"] == "call") & f["name"].isin(*names)


def _keyword(*parts: str, of: tuple[str, ...] = (), says=None):
    """A keyword of any call, or of those named, whose literal fits."""

    def test(f: Column) -> Column:
        hit = f["kind"].isin("keyword", "set") & F.when(f["kind"] == "set", f["name"]).otherwise(f["part"]).isin(*parts)
        hit &= f["name"].isin(*of) if of else F.lit(True)
        return hit & says(f) if says else hit

    return test


def _value(*values: str):
    return lambda f: F.lower(F.coalesce(f["value"], F.lit(""))).isin(*values)


def _any(*tests):
    def test(f: Column) -> Column:
        hit = tests[0](f)
        for t in tests[1:]:
            hit |= t(f)
        return hit

    return test


def _map_name(f: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(f["value"], f["name"])), "_r$", "").isin(*RAINBOWS)


_DRAWN, _BARS = _call(*PLOTS), _call("bar", "barh", "barplot")
_FLAT = _keyword("explode", "shadow", of=("pie",), says=lambda f: F.coalesce(f["value"], F.lit("")) != "False")
_THREE_D = _any(lambda f: (f["kind"] == "name") & f["name"].isin("Axes3D", "plot_surface", "bar3d", "plot_wireframe", "plot3D", "scatter3D"), _keyword("projection", says=_value("3d")))
_CUT_AXIS = _any(
    lambda f: (f["kind"] == "argument") & f["name"].isin("set_ylim", "set_xlim", "ylim", "xlim") & (f["part"] == "0") & (f["number"] > 0),
    _keyword("bottom", "left", "ymin", "xmin", of=("set_ylim", "set_xlim", "ylim", "xlim"), says=lambda f: f["number"] > 0),
)
_RAINBOW = _any(_keyword("cmap", says=_map_name), lambda f: (f["kind"] == "name") & f["owner"].rlike(r"(^|\.)cm$") & _map_name(f))
_RANDOM = _any(lambda f: (f["kind"] == "call") & f["owner"].rlike(r"(^|\.)random$"), _call("sample"))
_SEEDED = _any(
    lambda f: (f["kind"] == "call") & (f["name"] == "seed"), lambda f: (f["kind"] == "argument") & f["name"].isin("default_rng", "RandomState") & f["number"].isNotNull(),
    lambda f: f["kind"].isin("keyword", "set") & F.concat(f["part"], F.lit(" "), f["name"]).rlike("seed|random_state"),
)
_X_NAMED = _any(_call("set_xlabel", "xlabel"), _keyword("xlabel"))
_Y_NAMED = _any(_call("set_ylabel", "ylabel"), _keyword("ylabel"))
_ERRORS = _any(_call("errorbar"), _keyword("yerr", "xerr"))
_SPREAD_SAID = lambda f: F.when(f["kind"] == "text", f["value"]).when(f["kind"] == "name", f["name"]).rlike(r"(?i)(^|[^A-Za-z])(sd|sem|se|ci|s\.d\.|std|confidence)($|[^A-Za-z])")
_PANELS = _any(lambda f: (f["kind"] == "argument") & (f["name"] == "subplots") & f["part"].isin("0", "1") & (f["number"] >= 2), _keyword("nrows", "ncols", of=("subplots",), says=lambda f: f["number"] >= 2))
_SHARED = _any(_keyword("sharex", "sharey"), _call("set_xlim", "set_ylim"))
_saved = lambda ending: lambda f: (f["kind"] == "argument") & (f["name"] == "savefig") & (f["part"] == "0") & F.lower(F.coalesce(f["value"], F.lit(""))).rlike(rf"\.({ending})$")
_LOG = _any(lambda f: (f["kind"] == "argument") & f["name"].isin("set_xscale", "set_yscale", "xscale", "yscale") & F.coalesce(f["value"], F.lit("")).startswith("log"), _call("loglog", "semilogx", "semilogy"), _keyword("xscale", "yscale", says=lambda f: F.coalesce(f["value"], F.lit("")).startswith("log")))
_POINTS = _any(_call("scatter", "stripplot", "swarmplot", "violinplot", "boxplot"), _keyword("marker", of=("plot",)), lambda f: f["name"].contains("jitter") | f["part"].contains("jitter"))
_SMALL = _keyword("fontsize", "labelsize", "titlesize", "font_size", says=lambda f: f["number"] < LEAST_SIZE)
_TITLED = _any(_call("set_title", "suptitle", "title_bottom", "title"), lambda f: (f["kind"] == "call") & (f["name"] == "text") & f["owner"].rlike(r"(^|\.)fig$"))

#: (rule, severity, what breaks it, sets of facts that excuse it when a script has one of each set, whether its line is told, message).
RULES = (
    ("H2", "FAIL", _THREE_D, (), True, "three dimensions hide values"),
    ("H1", "FAIL", _FLAT, (), True, "a pie must be flat"),
    ("K3", "FAIL", _RAINBOW, (), True, "a rainbow scale misleads; use a sequential or diverging one"),
    ("K2", "FAIL", lambda f: (f["kind"] == "text") & _value(*NEON)(f), (), True, "neon colours are hard to read on white"),
    ("H8", "WARN", _call("fillna", "interpolate"), (), True, "a filled value wasn't measured: give the reason and mark it"),
    ("P3", "WARN", _RANDOM, ((_SEEDED,),), False, "random numbers without a seed"),
    ("S2", "WARN", _DRAWN, ((_X_NAMED, _Y_NAMED), (_call("pie"),)), False, "axes need names and units"),
    ("E3", "WARN", _ERRORS, ((_SPREAD_SAID,),), False, "say what the error bars are"),
    ("H9", "WARN", _PANELS, ((_SHARED,),), False, "panels that are compared need one axis"),
    ("P2", "WARN", _call("savefig"), ((_saved("svg|pdf"), _saved("png")),), False, "save as a vector file and as png"),
    ("H6", "WARN", _LOG, (), True, "label a log scale, and consider a linear one beside it"),
    ("H1b", "WARN", _call("pie"), (), True, "a pie is for a few parts of a stated whole"),
    ("E4", "WARN", _BARS, ((_POINTS,),), False, "show the observations, not just bars"),
    ("hyg", "WARN", lambda f: _call("plot", "bar", "scatter", "hist", "savefig")(f) & (f["owner"] == "plt"), (), True, "draw on axes of your own, not through plt"),
    ("T1", "FAIL", _SMALL, (), True, "letters under 8 points"),
    ("T2", "WARN", _DRAWN, ((_TITLED,),), False, "no title: the caption must say it"),
    ("T2", "WARN", _keyword("fontweight", of=("set_title",), says=_value("normal", "light")), (), False, "the title isn't bold"),
    ("parse", "INFO", lambda f: f["kind"] == "broken", (), True, "not a script that can be read: no rule was looked at"),
)


def lint(scripts: DataFrame) -> DataFrame:
    """The first place where each rule is broken in each script: path, rule, severity, line (null if it's the whole script), message.

    A null text is empty and breaks no rule; a script that can't be parsed has one finding that says so. Each different text is
    parsed once, rules are expressions over its facts, and scripts meet the findings of their text.
    """

    @F.pandas_udf(_FACT)
    def parse(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip(FACT, f, strict=True)) for f in facts(t or "")])

    scripts = scripts.select("path", F.coalesce("text", F.lit("")).alias("text"))
    # told to be nondeterministic, or filters on its facts would be moved below the distinct texts and parse every script
    parsed = scripts.select("text").distinct().select("text", parse.asNondeterministic()("text").alias("facts"))

    def has(test) -> Column:
        return F.coalesce(F.exists("facts", test), F.lit(False))

    def lines(test) -> Column:
        return F.transform(F.filter("facts", test), lambda f: f["line"])

    def finding(rule: str, severity: str, breaks, excuses: tuple, placed: bool, message: str) -> Column:
        broken = has(breaks)
        for needed in excuses:
            excused = F.lit(True)
            for test in needed:
                excused &= has(test)
            broken &= ~excused
        line = F.array_min(lines(breaks)) if placed else F.lit(None).cast("int")
        return F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), line.alias("line"), F.lit(message).alias("message")))

    # bars on an axis that is cut: two calls that only together break a rule
    bars = F.when(has(_BARS) & has(_CUT_AXIS), F.struct(F.lit("H3").alias("rule"), F.lit("FAIL").alias("severity"), F.array_min(lines(_BARS)).alias("line"), F.lit("bars must begin at zero").alias("message")))
    found = F.array_compact(F.array(*[finding(*r) for r in RULES], bars))
    broken = parsed.select("text", found.alias("found")).where(F.size("found") > 0)
    return scripts.join(broken, "text").select("path", F.explode("found").alias("f")).select("path", "f.*")


def review_card(findings: list[dict]) -> str:
    """A Markdown table of findings."""
    return "\n".join(["| rule | severity | line | message |", "|---|---|---|---|", *[f"| {f['rule']} | {f['severity']} | {f['line'] or ''} | {f['message']} |" for f in findings]])


def categorical_colors(n: int) -> list[str]:
    """Colours of ``n`` unordered groups, as many as can be told apart."""
    known = PALETTES["categorical"]
    if n > len(known):
        raise ValueError(f"{n} groups can't be told apart by colour, {len(known)} can: split the figure, merge groups or highlight some")
    return list(known[:n])


def colormap_for(kind: str) -> str:
    """The map for ordered magnitudes ("sequential"), counts ("density") or change around a centre ("diverging")."""
    if not isinstance(PALETTES.get(kind), str):
        raise ValueError(f"{kind!r} is none of {', '.join(k for k, v in PALETTES.items() if isinstance(v, str))}; unordered groups use categorical_colors")
    return PALETTES[kind]


#: Letters of a figure, in points above the base size.
_SIZES = {"font.size": 0, "xtick.labelsize": 0, "ytick.labelsize": 0, "legend.fontsize": 0, "legend.title_fontsize": 0, "axes.labelsize": 1, "axes.titlesize": 3, "figure.titlesize": 4}
_SETTINGS = {"axes.titleweight": "bold", "figure.titleweight": "bold", "axes.spines.top": False, "axes.spines.right": False, "legend.frameon": False, "figure.dpi": 100, "savefig.dpi": 300, "savefig.bbox": "tight"}


def figure_defaults(font_size: float = 10) -> dict:
    """Settings for any plotting library that takes them by name: readable letters, safe colours, no needless lines."""
    return {k: max(font_size + more, LEAST_SIZE) for k, more in _SIZES.items()} | _SETTINGS | {"colors": categorical_colors(len(PALETTES["categorical"]))}
