"""The library's functions by name, for use in plain SQL.

    register(spark)
    spark.sql("SELECT hex16(gradient_bits(token_grid(text))) FROM parquet.`.../documents.parquet`")

All are SQL functions, so that the optimiser sees through them and nothing leaves the JVM; top_k is a table function for
lateral joins.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .landmarks import KNUCKLES, MIDDLE, POINTS, TINY, TIPS

_LENGTH = "sqrt(aggregate({0}, 0D, (a, v) -> a + v * v))"
_PAIRS = [(t, TIPS[0]) for t in TIPS[1:]] + list(zip(TIPS[1:], TIPS[2:])) + list(KNUCKLES.items())
_APART = "sqrt(aggregate(zip_with(it[{0}], it[{1}], (a, b) -> (a - b) * (a - b)), 0D, (a, v) -> a + v))"


def _with(value: str, body: str, name: str = "it") -> str:
    """body with name bound to value, so that value is written and computed once: functions of functions stay as long as
    their bodies together, wherever the optimiser moves them."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_SPAN = f"array_max(transform(it, q -> {_LENGTH.format('q')}))"
_REACH = f"sqrt(it[{MIDDLE}][0] * it[{MIDDLE}][0] + it[{MIDDLE}][1] * it[{MIDDLE}][1])"
_TURNED = f"transform(it, p -> array((-it[{MIDDLE}][1] / g) * p[0] + (it[{MIDDLE}][0] / g) * p[1], (-it[{MIDDLE}][0] / g) * p[0] + (-it[{MIDDLE}][1] / g) * p[1], p[2]))"

#: name, parameters, result, body. Each body names each of its parameters once.
FUNCTIONS = [
    ("hamming", "a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    ("hex16", "bits BIGINT", "STRING", "lpad(lower(hex(bits)), 16, '0')"),
    ("split_key", "seed INT, label STRING, content STRING", "STRING", "sha2(concat_ws(':', cast(seed AS STRING), label, content), 256)"),
    ("softmax", "z ARRAY<DOUBLE>", "ARRAY<DOUBLE>", _with(_with("z", "transform(it, v -> exp(v - array_max(it)))"), "transform(powers, p -> p / aggregate(powers, 0D, (a, v) -> a + v))", "powers")),
    ("argmax", "z ARRAY<DOUBLE>", "INT", _with("z", "cast(array_position(it, array_max(it)) - 1 AS INT)")),
    ("token_places", "said STRING", "ARRAY<INT>", r"transform(filter(split(lower(coalesce(said, '')), '\\s+'), w -> w != ''), w -> cast(cast(conv(substring(md5(w), 1, 4), 16, 10) AS INT) % 72 AS INT))"),
    ("run_ends", "ordered ARRAY<INT>", "ARRAY<INT>", _with("ordered", "filter(sequence(0, size(it) - 1), i -> coalesce(get(it, i) != get(it, i + 1), true))")),
    ("gaps", "ends ARRAY<INT>", "ARRAY<INT>", _with("ends", "transform(it, (e, k) -> e - coalesce(get(it, k - 1), -1) - 1)")),
    ("token_grid", "said STRING", "ARRAY<INT>", "gaps(run_ends(sort_array(concat(token_places(said), sequence(0, 71)))))"),
    ("gradient_bits", "grid ARRAY<INT>", "BIGINT", _with("grid", "aggregate(sequence(0, 63), 0L, (w, i) -> shiftleft(w, 1) | if(it[i div 8 * 9 + i % 8] > it[i div 8 * 9 + i % 8 + 1], 1L, 0L))")),
    ("points_of", "said ARRAY<DOUBLE>", "ARRAY<ARRAY<DOUBLE>>", _with("said", f"transform(sequence(0, {POINTS - 1}), i -> array(get(it, 3 * i), get(it, 3 * i + 1), get(it, 3 * i + 2)))")),
    ("sided", "points ARRAY<ARRAY<DOUBLE>>, hand STRING", "ARRAY<ARRAY<DOUBLE>>", _with("coalesce(startswith(lower(trim(hand)), 'l'), false)", "transform(points, p -> array(if(it, -p[0], p[0]), p[1], p[2]))")),
    ("moved", "points ARRAY<ARRAY<DOUBLE>>", "ARRAY<ARRAY<DOUBLE>>", _with("points", "transform(it, p -> zip_with(p, it[0], (a, b) -> a - b))")),
    ("scaled", "points ARRAY<ARRAY<DOUBLE>>", "ARRAY<ARRAY<DOUBLE>>", _with("points", _with(_SPAN, f"if(d > {TINY}, transform(it, p -> transform(p, v -> v / d)), NULL)", "d"))),
    ("upright", "points ARRAY<ARRAY<DOUBLE>>", "ARRAY<ARRAY<DOUBLE>>", _with("points", _with(_REACH, f"if(g <= {TINY}, it, {_TURNED})", "g"))),
    ("canonical_points", "points ARRAY<ARRAY<DOUBLE>>, hand STRING", "ARRAY<ARRAY<DOUBLE>>", f"upright(scaled(moved(sided({_with('points', f'if(size(it) = {POINTS}, it, NULL)')}, hand))))"),
    ("hand_features", "points ARRAY<ARRAY<DOUBLE>>", "ARRAY<DOUBLE>", _with("points", f"if(it IS NULL, NULL, concat(flatten(it), array({', '.join([_LENGTH.format(f'it[{t}]') for t in TIPS] + [_APART.format(a, b) for a, b in _PAIRS])})))")),
    ("landmark_features", "points ARRAY<ARRAY<DOUBLE>>, hand STRING", "ARRAY<DOUBLE>", "hand_features(canonical_points(points, hand))"),
]

#: name, parameters, columns, query.
TABLE_FUNCTIONS = [
    (
        "top_k", "held ARRAY<DOUBLE>, k INT", "rank INT, place INT, value DOUBLE",
        "SELECT cast(pos + 1 AS INT), s.place, -s.minus FROM (SELECT posexplode(slice(array_sort(transform(held, (v, i) -> struct(-v AS minus, i AS place))), 1, k)) AS (pos, s))",
    ),
]


def register(spark: SparkSession) -> None:
    """Makes all names known to a session, in place of earlier ones."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, columns, query in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
