"""The verbs: to, transform, synthetic, scan, analyze, and formulas by name.

Frames may be Spark, pandas, polars or Arrow ones, or traced ones; results are lazy Spark frames unless as_type asks for
something else. A traced frame, or lineage=True, gives a traced result for the verbs that keep lineage.
"""

from __future__ import annotations

import logging as _logging
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.config import Config, load
from loomframe.errors import LoomError, need_columns
from loomframe.functions.registry import Registry
from loomframe.operators import aggregate as agg
from loomframe.operators import columns as cols
from loomframe.operators import diff as differences
from loomframe.operators import encode, impute, lineage, profile
from loomframe.operators import lookup as look
from loomframe.operators.positions import place
from loomframe.sources import synthetic as made
from loomframe.sources.frames import as_frame, as_type as converted

_log = _logging.getLogger("loomframe")
#: Formulas by name; formulas.set_folder(...) adds a user's own.
formulas = Registry()


_config = Config()


def configure(folder: str | None = None, home: str | None = None) -> Config:
    """Read the settings (config.toml of a folder, of the home folder, defaults) and use them from now on: the seed of
    synthetic(), the type of results where as_type isn't given, the log level, and the folder of formulas."""
    global _config
    _config = load(folder, home)
    _log.setLevel({"error": "ERROR", "warn": "WARNING", "info": "INFO", "debug": "DEBUG"}[_config.log_level])
    if _config.formula_folder:
        formulas.set_folder(_config.formula_folder)
    return _config


def _list(x) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _spark() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise LoomError("there is no Spark session", "Create one first")
    return found


def _frame(x) -> DataFrame:
    return x.df if isinstance(x, lineage.Traced) else as_frame(_spark(), x)


def _done(verb: str, began: float, logging: bool, result, kind: str | None = None):
    if logging:
        _log.info("%s: planned in %.1f ms", verb, 1000 * (time.perf_counter() - began))
    return converted(result, kind or _config.as_type) if isinstance(result, DataFrame) else result


def to(bring_to, bring_from, bring, against, position=None, *, strategy=None, join_type="lookup", order_by=None, logging=False, lineage=False, as_type=None):
    """Columns of reference frames by key; see operators.lookup.lookup. bring_to: one frame, or a list of them."""
    began = time.perf_counter()
    if lineage and as_type:
        raise LoomError("lineage and as_type exclude each other")
    if isinstance(bring_to, (list, tuple)):
        return [to(t, bring_from, bring, against, position, strategy=strategy, join_type=join_type, order_by=order_by, logging=logging, lineage=lineage, as_type=as_type) for t in bring_to]
    if isinstance(bring_to, str):
        if bring_to != "@new":
            raise LoomError(f"'{bring_to}' is no frame", "Give one, or '@new'")
        ref = look.stacked([_frame(f) for f in (bring_from if isinstance(bring_from, (list, tuple)) else [bring_from])])
        pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in _list(bring)]
        return _done("to", began, logging, ref.select(*map(cols.quoted, _list(against)), *[cols.quoted(s).alias(d) for s, d in pairs]), as_type)
    refs = [_frame(f) for f in (bring_from if isinstance(bring_from, (list, tuple)) else [bring_from])]
    options = {"strategy": strategy, "join_type": join_type, "position": position, "order_by": order_by}
    if lineage or isinstance(bring_to, _Traced):
        return _done("to", began, logging, _traced(bring_to).to(look.stacked(refs), bring, against, **options))
    return _done("to", began, logging, look.lookup(_frame(bring_to), refs, bring, against, **options), as_type)


_Traced = lineage.Traced


def _traced(x) -> lineage.Traced:
    return x if isinstance(x, _Traced) else _Traced.start(_frame(x))


def _round(df: DataFrame, columns: list[str], suffix: str, strategy) -> DataFrame:
    how, digits = "round", 2
    if suffix:
        if suffix == "banker":
            how = "banker"
        elif suffix.isdigit():
            digits = int(suffix)
        else:
            raise LoomError(f"'@round:{suffix}' is no mode")
    own = dict(strategy or {})
    digits = int(own.pop("decimals", digits))
    names = {c: (s if isinstance(s, str) else s.get("name", f"{c}_round")) for c, s in own.items()}
    return cols.round_columns(df, columns, how, digits, names)


def transform(mode, df, columns=None, *, expression=None, where=None, by=None, name=None, order=None, position=None, strategy=None, infer=None, against=None, method=None, order_by=None, logging=False, lineage=False, as_type=None, **options):
    """One of the modes @filter @sort @calc @aggregate @round[:d|:banker] @roundup[:d] @rounddown[:d] @bankers_round @split
    @extract @datetime @onehot @onehotencode @label @bin @scale @harmonize @transpose @deduce @knn.

    position places new columns. order_by: the order of rows, where a mode depends on one."""
    began = time.perf_counter()
    verb, _, suffix = mode.partition(":")
    need_columns(sorted(_MODES), [verb], "mode")
    if lineage and as_type:
        raise LoomError("lineage and as_type exclude each other")
    given = {"columns": _list(columns), "expression": expression, "where": where, "by": by, "name": name, "order": order, "strategy": strategy, "infer": _list(infer), "against": against, "method": method, "order_by": order_by, "suffix": suffix, "options": options}
    if lineage or isinstance(df, _Traced):
        traced = _traced(df)
        if verb == "@calc":
            return _done(mode, began, logging, traced.calc(_formulas(given)))
        if verb == "@filter" and not given["columns"]:
            return _done(mode, began, logging, traced.filter(where))
        if verb == "@aggregate":
            return _done(mode, began, logging, traced.aggregate(_list(by), strategy, order_by=order_by) if order_by else traced.aggregate(_list(by), strategy))
        raise LoomError(f"'{verb}' keeps no lineage", "There are: @calc, @filter, @aggregate")
    frame = _frame(df)
    out = _MODES[verb](frame, given)
    if position is not None:
        out = place(out, [c for c in out.columns if c not in frame.columns], position)
    return _done(mode, began, logging, out, as_type)


def _formulas(g: Mapping) -> dict[str, str]:
    if isinstance(g["strategy"], Mapping) and g["expression"] is None:
        return dict(g["strategy"])
    texts, names = _list(g["expression"]), _list(g["name"])
    for t in texts:
        if t.startswith(("inbuilt:", "user:")):
            raise LoomError(f"'{t}' is a named formula", f"Call formulas.{t.partition(':')[2]}(df)")
    if not texts:
        raise LoomError("@calc needs an expression")
    names = names or (["result"] if len(texts) == 1 else [f"result_{i}" for i in range(len(texts))])
    if len(names) != len(texts):
        raise LoomError(f"{len(texts)} formulas but {len(names)} names")
    return dict(zip(names, texts, strict=True))


def _sorted(df: DataFrame, g: Mapping) -> DataFrame:
    order = g["order"] or (g["strategy"] if isinstance(g["strategy"], (str, list, tuple)) else None) or "asc"
    return cols.sort(df, _list(g["by"]) or g["columns"], order)


def _scaled(way: str) -> Callable[[DataFrame, Mapping], DataFrame]:
    return lambda df, g: cols.round_columns(df, g["columns"], way, int(g["suffix"] or 2), {k: v for k, v in (g["strategy"] or {}).items() if isinstance(v, str)})


def _harmonized(df: DataFrame, g: Mapping) -> DataFrame:
    """strategy: {column: {kind, from, to, rate?, name?}}."""
    if not g["strategy"]:
        raise LoomError("@harmonize needs a strategy", "{column: {'kind': 'weight', 'from': 'kg', 'to': 'lb'}}")
    for c, s in g["strategy"].items():
        df = cols.harmonize(df, c, s["kind"], s.get("from", ""), s.get("to", ""), s.get("name"), s.get("rate"))
    return df


def _deduced(df: DataFrame, g: Mapping) -> DataFrame:
    wanted = g["infer"] or g["columns"]
    methods = _list(g["method"]) or ["auto"]
    if len(methods) == 1:
        methods *= len(wanted)
    if len(methods) != len(wanted):
        raise LoomError(f"{len(wanted)} columns but {len(methods)} methods")
    names = _list(g["name"]) or [None] * len(wanted)
    for c, m, n in zip(wanted, methods, names, strict=True):
        df = impute.deduce(df, c, m, order_by=g["order_by"], name=n, against=_list(g["against"]) or None, within=_list(g["by"]), **(g["strategy"] or {}))
    return df


def _knn_in_place(df: DataFrame, g: Mapping) -> DataFrame:
    """Overwrites the columns, with themselves as features."""
    names = {c: f"__knn_{i}" for i, c in enumerate(g["columns"])}
    out = impute.knn(df, g["columns"], features="self", names=names, order_by=g["order_by"], **(g["strategy"] or {}))
    return out.select(*[cols.quoted(names.get(c, c)).alias(c) for c in df.columns])


_MODES: dict[str, Callable[[DataFrame, Mapping], DataFrame]] = {
    "@filter": lambda df, g: cols.filter_rows(df, g["where"], g["columns"]),
    "@sort": _sorted,
    "@calc": lambda df, g: cols.calc(df, _formulas(g)),
    "@aggregate": lambda df, g: agg.aggregate(df, _list(g["by"]), g["strategy"] or {}, g["order_by"]),
    "@round": lambda df, g: _round(df, g["columns"], g["suffix"], g["strategy"]),
    "@bankers_round": lambda df, g: _round(df, g["columns"], "banker", g["strategy"]),
    "@roundup": _scaled("up"),
    "@rounddown": _scaled("down"),
    "@split": lambda df, g: cols.split(df, g["columns"][0], g["by"] or " ", **g["options"]),
    "@extract": lambda df, g: cols.extract(df, g["columns"], g["strategy"] if isinstance(g["strategy"], (list, tuple)) else None, g["expression"]),
    "@datetime": lambda df, g: cols.extract(df, g["columns"], g["strategy"] if isinstance(g["strategy"], (list, tuple)) else None),
    "@onehot": lambda df, g: encode.onehot(df, g["columns"], **(g["strategy"] or {})),
    "@onehotencode": lambda df, g: encode.onehot(df, g["columns"], **(g["strategy"] or {})),
    "@label": lambda df, g: encode.label(df, g["columns"]),
    "@bin": lambda df, g: cols.bin_column(df, g["columns"][0], **(g["strategy"] or {})),
    "@scale": lambda df, g: cols.scale(df, g["columns"], g["method"] or "normalize"),
    "@harmonize": _harmonized,
    "@transpose": lambda df, g: encode.transpose(df, g["columns"][0] if g["columns"] else None),
    "@deduce": _deduced,
    "@knn": _knn_in_place,
}


def synthetic(df_or_mode, n: int | None = None, *, strategy=None, seed: int | None = None, logging=False, as_type=None):
    """'@new': a frame of n rows by strategy; a frame: that frame and n rows like it."""
    began = time.perf_counter()
    if n is None:
        raise LoomError("how many rows?", "n=...")
    seed = _config.seed if seed is None else seed
    if isinstance(df_or_mode, str):
        if df_or_mode != "@new":
            raise LoomError(f"no mode '{df_or_mode}'", "There is: @new")
        return _done("synthetic", began, logging, made.new(_spark(), n, strategy or {}, seed), as_type)
    return _done("synthetic", began, logging, made.augment(_frame(df_or_mode), n, seed, strategy), as_type)


def scan(mode, df=None, *, old=None, new=None, key=None, columns=None, where=None, rows=None, order_by=None, trace=None, focus=None, strategy=None, folder=None, logging=False, as_type=None):
    """@analyze, @diff, @lineage, @set."""
    began = time.perf_counter()
    if mode == "@analyze":
        return analyze(df, columns=columns, where=where, rows=rows, order_by=order_by, focus=focus, as_type=as_type, logging=logging)
    if mode == "@diff":
        if old is None or new is None:
            raise LoomError("@diff needs old and new")
        rules = None
        given = dict(strategy or {})
        for name in ("groups", "aliases"):
            if isinstance(given.get(name), str):
                rules = formulas.reconciliation(given.pop(name))
        result = differences.diff(_frame(old), _frame(new), key, given, rules)
        return _done(mode, began, logging, differences.ordered(result) if given.get("ordered") else result, as_type)
    if mode == "@lineage":
        traced = lineage.need_traced(df)
        if trace is not None:
            column, ids = (trace[0], [trace[1]]) if isinstance(trace, (list, tuple)) and len(trace) == 2 and isinstance(trace[0], str) else (None, [trace] if isinstance(trace, int) else _list(trace))
            found = traced.trace(ids)
            if column:  # a cell: the input columns that it goes back to
                found = found.select(lineage.ROW_ID, *[c for c in traced.dependencies(column) if c in found.columns])
            return _done(mode, began, logging, found, as_type)
        if focus == "excluded":
            return _done(mode, began, logging, traced.excluded(), as_type)
        if focus == "source":
            return {c: s.kind for c, s in traced.sources.items()}
        if focus == "nulls":
            return _done(mode, began, logging, profile.nulls(traced.plain), as_type)
        return traced.report()
    if mode == "@set":
        return formulas.set_folder(folder or df) if (folder or df) not in (None, "show") else str(formulas.folder or "")
    raise LoomError(f"no mode '{mode}'", "There are: @analyze, @diff, @lineage, @set")


def analyze(df, *, columns: Sequence[str] | str | None = None, where=None, rows=None, order_by=None, focus=None, as_type=None, logging=False):
    """A profile, or with focus one of: outliers, correlations, distributions, nulls, and excluded (of a traced frame: the
    input rows that it has lost). as_type: also dict or text."""
    began = time.perf_counter()
    if focus == "excluded":
        return _done("@analyze", began, logging, lineage.need_traced(df).excluded(), as_type)
    frame = cols.filter_rows(_frame(df), where, _list(columns) or None)
    if rows:
        if not order_by:
            raise LoomError("rows need an order", "order_by='...'")
        frame = cols.rows(frame, rows, order_by)
    if focus:
        ways = {"outliers": profile.outliers, "correlations": profile.correlations, "nulls": profile.nulls, "distributions": _distributions}
        need_columns(list(ways), [focus], "focus")
        return _done("@analyze", began, logging, ways[focus](frame), as_type)
    result = profile.analyze(frame)
    if as_type in ("dict", "text"):
        return profile.as_dict(result) if as_type == "dict" else profile.as_text(result)
    return _done("@analyze", began, logging, result, None if as_type == "dataframe" else as_type)


analyse = analyze


def _distributions(df: DataFrame) -> DataFrame:
    numbers = [f.name for f in df.schema if f.dataType.simpleString() in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    if not numbers:
        raise LoomError("there is no numeric column")
    parts = [profile.distribution(df, c).select(F.lit(c).alias("column"), "bin", "low", "high", "rows") for c in numbers]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pipe(df, function: Callable, *args, **kwargs):
    """function(df, ...), for chains."""
    return function(df, *args, **kwargs)
