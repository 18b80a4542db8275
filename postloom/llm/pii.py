"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose overlapping spans: the base patterns, and, in a text in which the base spans
are masked, runs of digits, groups of digits, numbers that are written like phone numbers but lack a plus sign, and
spelled-out addresses.  So a card or a phone number that a base pattern swallowed together with its neighbour
is proposed on its own.  Each candidate gets binned features of its format, checks and context.

Labels: what a base check confirms is positive.  Negative is what a base check drops, and a candidate inside a
longer token of letters and digits.  All others are not labelled, and are what the model decides on.  Boosted
trees learn from all documents' labelled candidates.  Because features are small bins, these come down to
one histogram of a bounded size, which is exact for the whole corpus.  A kind's threshold is the least score
from which on the held-out half of the histogram keeps the wanted precision.  Base spans always stay; other
candidates are added from the threshold on.

Everything is row-local but for that histogram, so texts are never shuffled.  Patterns are written so that
they are linear on long runs and don't recurse: dots and separators that stand between the right characters
are first marked one for one, which keeps positions.  Arrays of n matches are built in groups of the square
root of n, since appending to one array would copy it n times.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
#: Confirmed candidates that a threshold must rest on, and documents' folds: one is held out for calibration.
SUPPORT = 50
TREES, RATE = 24, 0.3

#: Noncharacters that stand for a marked dot, a marked separator, for themselves where a text has them, and for masked characters.
_DOT, _SEPARATOR, _OTHER, _MASK = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_LOCAL = rf"A-Za-z0-9._%+\-{_DOT}"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
CARD = rf"[0-9][0-9{_SEPARATOR}]++"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
#: Generators over masked texts: a run of digits, groups of digits, a number with or without a plus sign, a spelled-out address.
RUN = r"(?<![0-9])[0-9]{14,19}(?![0-9])"
GROUPS = r"(?<![0-9])[0-9]{4}(?:[ .\-][0-9]{4}){2}[ .\-][0-9]{2,7}(?![0-9])"
NUMBER = r"(?<![0-9])[+]?[(]?[0-9][0-9 ().\-]{8,24}[0-9](?![0-9])"
SPELLED = r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,64}(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]{1,64}"

#: Words before a candidate that tell what follows.
CUES = ("phone", "tel", "call", "mobile", "fax", "contact", "mail", "card", "visa", "credit", "account", "ssn", "iban")
NOISE = ("version", "order", "id", "isbn", "page", "no", "number", "ref", "item")

#: Features and their numbers of bins; their product bounds the histogram.
FEATURES = {"kind": 4, "digits": 5, "separators": 4, "brackets": 2, "leads": 3, "before": 4, "after": 4, "cue": 3, "passes": 2}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_MATCH = "struct<start:int,end:int,said:string,before:string,after:string>"
_GAP = "struct<gap:int,said:string,before:string,after:string>"


def _literals(names: tuple[str, ...]) -> str:
    return ", ".join(map(_literal, names))


def _gaps(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern: array of (gap before it in code points, said, before, after).

    The text is split at the matches, and the ends of the gaps are the context, so no match walks the text again.
    """
    p = _literal(pattern)
    gaps, said = f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, 0)"
    return f"""zip_with(zip_with(slice({gaps}, 1, size({said})), {said}, (gap, said) -> struct(length(gap) as gap, said as said, right(gap, 16) as before)),
      slice({gaps}, 2, size({said})), (x, gap) -> struct(x.gap as gap, x.said as said, x.before as before, left(gap, 1) as after))"""


def _held(df: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    """Adds a struct of SQL expressions, evaluated once a row.

    Exploding one struct into one row keeps the optimizer from copying the expressions into lambdas, where they
    would be evaluated once for each element.
    """
    return df.withColumn(name, F.explode(F.expr(f"array(struct({', '.join(f'{e} as {n}' for n, e in fields.items())}))")))


def _groups(items: str) -> str:
    """SQL for an array cut into groups of the square root of its size."""
    each = f"cast(greatest(1, ceil(sqrt(size({items})))) as int)"
    return f"transform(sequence(0, cast((greatest(size({items}), 1) - 1) div {each} as int)), g -> slice({items}, g * {each} + 1, {each}))"


def _placed(gaps: str) -> str:
    """SQL for matches with positions, from gaps: running sums inside groups, and over the groups' sums."""
    groups, width = _groups(gaps), "x.gap + length(x.said)"
    sums = f"transform({groups}, g -> aggregate(g, 0, (a, x) -> a + {width}))"
    begins = f"aggregate({sums}, array(0), (a, s) -> concat(a, array(element_at(a, -1) + s)))"
    inside = f"""aggregate(g, struct(o as at, cast(array() as array<{_MATCH}>) as found),
      (a, x) -> struct(a.at + {width} as at, concat(a.found, array(named_struct('start', a.at + x.gap, 'end', a.at + {width}, 'said', x.said, 'before', x.before, 'after', x.after))) as found),
      a -> a.found)"""
    return f"flatten(zip_with({groups}, slice({begins}, 1, size({groups})), (g, o) -> {inside}))"


def _replaced(df: DataFrame, name: str, text: str, spans: str, instead: str, covered: str) -> DataFrame:
    """Adds the text with its spans (sorted structs with start and end) replaced.

    ``instead`` is SQL for what stands for a span ``s`` that begins at or after ``a.at``, where the last one ended;
    ``covered`` for one that begins before and ends after it.  Each group of spans cuts its own stretch off the text first.
    """
    groups = _groups(spans)
    ends = f"aggregate(transform({groups}, g -> array_max(transform(g, s -> s.end))), array(0), (a, m) -> concat(a, array(greatest(element_at(a, -1), m))))"
    df = _held(df, f"{name}_cut", {"own": groups, "ends": ends})
    cut = f"{name}_cut"
    stretches = f"transform({cut}.own, (g, i) -> struct(g as own, {cut}.ends[i] as at, substring({text}, {cut}.ends[i] + 1, {cut}.ends[i + 1] - {cut}.ends[i]) as said))"
    parts = f"""transform({name}_said.said, x -> aggregate(x.own, struct(x.at as at, cast(array() as array<string>) as parts),
      (a, s) -> struct(greatest(a.at, s.end) as at, case when s.end <= a.at then a.parts when s.start < a.at then concat(a.parts, array({covered}))
        else concat(a.parts, array(substring(x.said, a.at - x.at + 1, s.start - a.at), {instead})) end as parts), a -> array_join(a.parts, '')))"""
    df = _held(df, f"{name}_said", {"said": f"case when size({spans}) = 0 then null else {stretches} end"})
    out = f"case when size({spans}) = 0 then {text} else concat(array_join({parts}, ''), substring({text}, element_at({cut}.ends, -1) + 1)) end"
    return _held(df, f"{name}_out", {"said": out}).withColumn(name, F.col(f"{name}_out.said")).drop(cut, f"{name}_said", f"{name}_out")


_DIGITS = "length(regexp_replace(x.said, '[^0-9]', ''))"


def _with_base(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_tried``, the base patterns' matches with whether their check passes, and ``_base``: sorted array of (start, rank, end), rank being the kind's place from 1."""
    t, none = "_text", f"cast(array() as array<{_GAP}>)"
    df = df.withColumn(t, F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _DOT + _SEPARATOR + _MASK, _OTHER * 3))
    digits = f"{t} rlike '[0-9]'"
    dotted = f"regexp_replace({t}, '(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])', '{_DOT}')"
    joined = f"regexp_replace({t}, '(?<=[0-9])[ -](?=[0-9])', '{_SEPARATOR}')"
    df = df.withColumns({
        "_dotted": F.expr(f"case when contains({t}, '@') then {dotted} else '' end"),
        "_joined": F.expr(f"case when {digits} then {joined} else '' end"),
    })
    df = _held(df, "_gaps", {
        "email": f"case when _dotted = '' then {none} else {_gaps('_dotted', EMAIL)} end",
        "ip": f"case when {t} rlike '[0-9][.][0-9]' then {_gaps(t, IP)} else {none} end",
        "card": f"case when _joined = '' then {none} else filter({_gaps('_joined', CARD)}, x -> true) end",
        "phone": f"case when {t} rlike '[+][0-9]' then {_gaps(t, PHONE)} else {none} end",
    })
    df = _held(df, "_found", {k: f"case when size(_gaps.{k}) = 0 then cast(array() as array<{_MATCH}>) else {_placed(f'_gaps.{k}')} end" for k in KINDS})
    number = "regexp_replace(x.said, '[^0-9]', '')"
    checks = {"email": "true", "ip": f"x.said rlike {_literal(IP_VALID)}", "card": f"length({number}) between 14 and 19 and luhn_check({number})", "phone": f"length({number}) between 10 and 15"}
    tried = [f"transform(_found.{k}, x -> struct(x.start as start, {r} as rank, x.end as end, {checks[k]} as passes, x.said as said, x.before as before, x.after as after))" for r, k in enumerate(KINDS, 1)]
    df = _held(df, "_tried", {"all": f"concat({', '.join(tried)})"})
    base = "array_sort(transform(filter(_tried.all, x -> x.passes), x -> struct(x.start as start, x.rank as rank, x.end as end)))"
    return _held(df, "_kept", {"base": base}).withColumn("_base", F.col("_kept.base"))


def _with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``_candidates``: array of (start, end, rank, label, and the features); the label is null where nothing is known."""
    df = _replaced(df, "_masked", "_text", "_base", f"repeat('{_MASK}', s.end - s.start)", f"repeat('{_MASK}', s.end - a.at)")
    m, none = "_masked", f"cast(array() as array<{_GAP}>)"
    some = f"{m} rlike '[0-9][0-9 ().-]{{8,}}[0-9]'"
    df = _held(df, "_loose_gaps", {
        "run": f"case when {some} then {_gaps(m, RUN)} else {none} end",
        "groups": f"case when {some} then {_gaps(m, GROUPS)} else {none} end",
        "number": f"case when {some} then {_gaps(m, NUMBER)} else {none} end",
        "spelled": f"case when {m} rlike '[(\\\\[] ?at ?[)\\\\]]' then {_gaps(m, SPELLED)} else {none} end",
    })
    sources = {"run": 3, "groups": 3, "number": 4, "spelled": 1}
    df = _held(df, "_loose", {k: f"case when size(_loose_gaps.{k}) = 0 then cast(array() as array<{_MATCH}>) else {_placed(f'_loose_gaps.{k}')} end" for k in sources})
    number = "regexp_replace(x.said, '[^0-9]', '')"
    checks = {"run": f"luhn_check({number})", "groups": f"luhn_check({number})", "number": "true", "spelled": "true"}
    wanted = {"run": "true", "groups": f"{_DIGITS} between 14 and 19", "number": f"{_DIGITS} between 10 and 15", "spelled": "true"}
    inside = "x.before rlike '[A-Za-z0-9_]$' or x.after rlike '^[A-Za-z0-9_]'"
    loose = [f"transform(filter(_loose.{k}, x -> {wanted[k]}), x -> struct(x.start as start, x.end as end, {r} as rank, {checks[k]} as passes, x.said as said, x.before as before, x.after as after, if({inside}, 0, null) as label))" for k, r in sources.items()]
    base = "transform(_tried.all, x -> struct(x.start as start, x.end as end, x.rank as rank, x.passes as passes, x.said as said, x.before as before, x.after as after, if(x.passes, 1, 0) as label))"
    df = _held(df, "_proposed", {"all": f"concat({base}, {', '.join(loose)})"})
    kind_of = lambda c: f"case when {c} = '' then 0 when {c} rlike '[A-Za-z]' then 1 when {c} rlike '[0-9]' then 2 else 3 end"
    cue = lambda words: f"lower(x.before) rlike '(^|[^a-z])({'|'.join(words)})[^a-z]*$'"
    features = f"""transform(_proposed.all, x -> named_struct('start', x.start, 'end', x.end, 'rank', x.rank, 'label', x.label,
      'kind', x.rank - 1,
      'digits', case when {_DIGITS} < 10 then 0 when {_DIGITS} < 12 then 1 when {_DIGITS} < 14 then 2 when {_DIGITS} < 20 then 3 else 4 end,
      'separators', least(3, length(regexp_replace(x.said, '[^ .{_SEPARATOR}-]', ''))),
      'brackets', case when x.said rlike '[()\\\\[]' then 1 else 0 end,
      'leads', case when x.said rlike '^[+(]*0' then 0 when x.said rlike '^[+(]*[1-9]' then 1 else 2 end,
      'before', {kind_of("right(trim(x.before), 1)")}, 'after', {kind_of("x.after")},
      'cue', case when {cue(CUES)} then 2 when {cue(NOISE)} then 1 else 0 end,
      'passes', if(x.passes, 1, 0)))"""
    return _held(df, "_weighed", {"all": features}).withColumn("_candidates", F.col("_weighed.all"))


class Tree(NamedTuple):
    """A depth-two tree: at the root and in both halves a feature, the largest bin that goes left; four leaves."""

    splits: tuple[tuple[str, int], tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def leaf(self, row: dict) -> float:
        half = 0 if row[self.splits[0][0]] <= self.splits[0][1] else 1
        name, most = self.splits[1 + half]
        return self.leaves[2 * half + (row[name] > most)]

    def sql(self, at: str) -> str:
        (r, i), (a, j), (b, k) = self.splits
        w, x, y, z = (f"{v!r}D" for v in self.leaves)
        return f"if({at}.{r} <= {i}, if({at}.{a} <= {j}, {w}, {x}), if({at}.{b} <= {k}, {y}, {z}))"


class Model(NamedTuple):
    bias: float
    trees: list[Tree]
    thresholds: tuple[float, ...]  # by kind; infinite where nothing may be added

    def score(self, row: dict) -> float:
        return self.bias + sum(t.leaf(row) for t in self.trees)


def boost(rows: list[dict], trees: int = TREES, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Gradient boosting of the logistic loss over weighted rows (features, n, positives p)."""
    total, positive = sum(r["n"] for r in rows), sum(r["p"] for r in rows)
    if not total or positive in (0, total):
        return (0.0 if not total else 8.0 if positive else -8.0), []
    bias = math.log(positive / (total - positive))
    scores, out = [bias] * len(rows), []

    def best(own: list[int], slope: list[float], curve: list[float]) -> tuple[float, tuple[str, int]]:
        found = (-1.0, ("kind", 99))
        for name, bins in FEATURES.items():
            g, h = [0.0] * bins, [0.0] * bins
            for k in own:
                g[rows[k][name]] += slope[k]
                h[rows[k][name]] += curve[k]
            a, b, all_g, all_h = 0.0, 0.0, sum(g), sum(h)
            for v in range(bins - 1):
                a, b = a + g[v], b + h[v]
                gain = a * a / (b + 1) + (all_g - a) ** 2 / (all_h - b + 1)
                if gain > found[0] + 1e-12:
                    found = gain, (name, v)
        return found

    for _ in range(trees):
        share = [1 / (1 + math.exp(-s)) for s in scores]
        slope = [r["p"] - r["n"] * q for r, q in zip(rows, share, strict=True)]
        curve = [r["n"] * q * (1 - q) for r, q in zip(rows, share, strict=True)]
        root = best(range(len(rows)), slope, curve)[1]
        halves = [[k for k, r in enumerate(rows) if (r[root[0]] > root[1]) == side] for side in (False, True)]
        splits = (root, *(best(h, slope, curve)[1] for h in halves))
        leaves = []
        for h, (name, most) in zip(halves, splits[1:], strict=True):
            for side in (False, True):
                own = [k for k in h if (rows[k][name] > most) == side]
                leaves.append(rate * sum(slope[k] for k in own) / (sum(curve[k] for k in own) + 1))
        tree = Tree(splits, tuple(leaves))
        out.append(tree)
        scores = [max(-30.0, min(30.0, s + tree.leaf(r))) for s, r in zip(scores, rows, strict=True)]
    return bias, out


def calibrate(model: Model, rows: list[dict], precision: float = PRECISION, support: int = SUPPORT) -> tuple[float, ...]:
    """For each kind the least score from which on the rows keep the precision."""
    out = []
    for kind in range(len(KINDS)):
        own = sorted(((model.score(r), r["n"], r["p"]) for r in rows if r["kind"] == kind), reverse=True)
        n = p = 0
        least = math.inf
        for k, (s, m, q) in enumerate(own):
            n, p = n + m, p + q
            if (k + 1 == len(own) or own[k + 1][0] < s) and p >= support and p >= precision * n:
                least = s
        out.append(least)
    return tuple(out)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on all documents' labelled candidates; half of the documents, by a hash, calibrate the thresholds."""
    half = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(2)).alias("half")
    seen = _with_candidates(_with_base(docs.select(half, F.col(text_col).alias("_given")), "_given"))
    seen = seen.where("size(_candidates) > 0").select("half", F.explode("_candidates").alias("c")).where("c.label is not null").select("half", *(f"c.{x}" for x in FEATURES), "c.label")
    counts = seen.groupBy("half", *FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    rows = [r.asDict() for r in counts.orderBy("half", *FEATURES).collect()]  # at most 2 * the product of the bins
    bias, trees = boost([r for r in rows if r["half"] == 0])
    model = Model(bias, trees, ())
    return model._replace(thresholds=calibrate(model, [r for r in rows if r["half"] == 1]))


def _with_spans(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """Adds ``_spans``: the base spans and the candidates added, as ``_base``."""
    df = _with_base(df, text_col)
    open_ = [r for r, t in enumerate(model.thresholds, 1) if t < math.inf]
    if not open_ or not model.trees:
        return df.withColumn("_spans", F.col("_base"))
    score = f"{model.bias!r}D + " + " + ".join(t.sql("c") for t in model.trees)
    least = "case c.rank " + " ".join(f"when {r} then {model.thresholds[r - 1]!r}D" for r in open_) + " end"
    added = f"""transform(filter(_candidates, c -> c.label is null and c.rank in ({', '.join(map(str, open_))}) and ({score}) >= {least} - 1e-9D),
      c -> struct(c.start as start, c.rank as rank, c.end as end))"""
    df = _held(_with_candidates(df), "_chosen", {"spans": f"array_sort(concat(_base, array_distinct({added})))"})
    return df.withColumn("_spans", F.col("_chosen.spans"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({_literals(KINDS)}), s.rank), ':', s.start, ':', s.end)), ',')")


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    Counts and the digest are of base spans, which a null or empty text has none of; ``spans`` also holds
    those that the model added, each as kind:start:end in code points.  Null and repeated ids are kept;
    other columns are ignored.
    """
    model = model or train(docs, id_col, text_col)
    df = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_given")), "_given", model)
    counts = [F.expr(f"cast(size(filter(_base, s -> s.rank = {r})) as long)").alias(f"n_{k}") for r, k in enumerate(KINDS, 1)]
    return df.select("doc_id", *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in brackets; all columns stay, a null text stays null."""
    model = model or train(docs, id_col, text_col)
    told = "_given"
    inner = [f"_c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    df = _with_spans(docs.toDF(*inner).withColumn(told, F.col(inner[docs.columns.index(text_col)]).cast("string")), told, model)
    df = _replaced(df, "_redacted", told, "_spans", f"element_at(array({_literals(tuple(f'[{k.upper()}]' for k in KINDS))}), s.rank)", "''")
    return df.select(*(F.col("_redacted" if c == text_col else i).alias(c) for i, c in zip(inner, docs.columns, strict=True)))
