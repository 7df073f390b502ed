"""Oracle SQL for the raster corpora: common table expressions that the queries' SQL is built from."""

from __future__ import annotations

from platen.sources.rasters import COLUMNS, CONDITIONS, LINE, MARGIN, PAGE_HALF, PAGE_LEAST, PAGE_VALUE, TILTS, WIDTH

_CASES = " ".join(f"WHEN {k} THEN {e.replace(' div ', ' // ')}" for k, e in CONDITIONS.items())

#: Text rasters as `raw`, conditioned as `px`.
TEXT = f"""
chars AS (SELECT doc_id AS image_id, unnest(regexp_extract_all(text || repeat(' ', ({WIDTH} - length(text) % {WIDTH}) % {WIDTH}), '(?s).')) AS c,
  unnest(range(length(text) + ({WIDTH} - length(text) % {WIDTH}) % {WIDTH})) AS p FROM documents WHERE text IS NOT NULL AND text <> ''),
raw AS (SELECT image_id, CAST(p // {WIDTH} AS INTEGER) AS y, CAST(p % {WIDTH} AS INTEGER) AS x, CAST(unicode(c) % 256 AS INTEGER) AS v FROM chars),
px AS MATERIALIZED (SELECT image_id, y, x, CAST(CASE image_id % 8 {_CASES} ELSE v END AS INTEGER) AS v FROM raw)"""

#: Vector rasters as `px`.
VECTOR = """
es AS (SELECT vec_id AS image_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
flat AS (SELECT image_id, list_min(e) AS lo, list_max(e) AS hi, unnest(e) AS c, unnest(range(len(e))) AS p FROM es),
px AS MATERIALIZED (SELECT image_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
  CAST(CASE WHEN hi > lo THEN floor(255 * (c - lo) / (hi - lo) + 0.5) ELSE 0 END AS INTEGER) AS v FROM flat)"""


#: Drawn pages' frames as `fr`, and their pixels as `px`.
FRAMES = f"""
f0 AS (SELECT item_id AS image_id, coalesce(text, '') AS text, CAST(item_id % 4 AS INTEGER) AS kind, [{', '.join(str(c) for c, _ in TILTS)}][item_id % 7 + 1] AS c, [{', '.join(str(s) for _, s in TILTS)}][item_id % 7 + 1] AS s,
  CAST(greatest({PAGE_LEAST}, {MARGIN + 1} + {LINE // 2} * ceil(length(coalesce(text, '')) / {COLUMNS})) AS INTEGER) AS half FROM benchmark),
fr AS (SELECT *, CAST(2 * half + 60 + (2 * abs(s) * {PAGE_HALF}) // 1000 AS INTEGER) AS height, CAST({2 * PAGE_HALF + 80} + (2 * abs(s) * half) // 1000 AS INTEGER) AS width FROM f0)"""
PAGES = f"""{FRAMES},
fy AS (SELECT *, unnest(range(height)) AS y FROM fr), fx AS (SELECT *, unnest(range(width)) AS x FROM fy),
uw AS (SELECT *, c * (2 * x - width + 1) + s * (2 * y - height + 1) AS u, c * (2 * y - height + 1) - s * (2 * x - width + 1) AS w FROM fx),
px AS MATERIALIZED (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST({PAGE_VALUE.format(u='u', w='w', div='//')} AS INTEGER) AS v FROM uw)"""


def around(src: str, out: str, border: str = "reflect101", value: str = "v", keep: str = "v") -> str:
    """CTE `out`: the 3 x 3 neighbourhood n0..n8 of each pixel of `src`."""
    fill = {"reflect101": "coalesce({a}, {b}, {v})", "replicate": "coalesce({a}, {v})", "ignore": "{a}"}[border]

    def side(v: str, one: str, two: str, w: str) -> str:
        return fill.format(a=f"{one}({v}) OVER {w}", b=f"{two}({v}) OVER {w}", v=v)

    cols = ", ".join(f"{side(c, 'lag', 'lead', 'c')} AS n{i}, {c} AS n{i + 3}, {side(c, 'lead', 'lag', 'c')} AS n{i + 6}" for i, c in enumerate(("l", "m", "r")))
    kept = "".join(f", {k}" for k in keep.split(",") if k)
    return f"""{out}_h AS (SELECT *, {value} AS m, {side(value, 'lag', 'lead', 'h')} AS l, {side(value, 'lead', 'lag', 'h')} AS r FROM {src} WINDOW h AS (PARTITION BY image_id, y ORDER BY x)),
{out} AS (SELECT image_id, y, x{kept}, {cols} FROM {out}_h WINDOW c AS (PARTITION BY image_id, x ORDER BY y))"""


def blurred(src: str, out: str, kernel: list[float], border: str = "reflect101", value: str = "v", name: str = "g") -> str:
    """CTE `out`: `src` with `name`, its separable convolution, by joins to mirrored places."""
    r = len(kernel) // 2
    ks = ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(kernel))

    def place(i: str, n: str) -> str:
        if border == "replicate":
            return f"greatest(0, least({n} - 1, {i}))"
        m = f"((({i}) % greatest(2 * ({n} - 1), 1) + greatest(2 * ({n} - 1), 1)) % greatest(2 * ({n} - 1), 1))"
        return f"CASE WHEN {n} = 1 THEN 0 WHEN {m} < {n} THEN {m} ELSE 2 * ({n} - 1) - {m} END"

    return f"""{out}_k(d, w) AS (VALUES {ks}),
{out}_s AS (SELECT image_id, max(y) + 1 AS hh, max(x) + 1 AS ww FROM {src} GROUP BY image_id),
{out}_a AS (SELECT p.image_id, p.y, p.x, k.w, {place('p.x + k.d', 's.ww')} AS tx FROM {src} p JOIN {out}_s s USING (image_id) CROSS JOIN {out}_k k),
{out}_h AS (SELECT a.image_id, a.y, a.x, sum(a.w * q.{value}) AS hv FROM {out}_a a JOIN {src} q ON q.image_id = a.image_id AND q.y = a.y AND q.x = a.tx GROUP BY ALL),
{out}_b AS (SELECT p.image_id, p.y, p.x, k.w, {place('p.y + k.d', 's.hh')} AS ty FROM {src} p JOIN {out}_s s USING (image_id) CROSS JOIN {out}_k k),
{out}_g AS (SELECT b.image_id, b.y, b.x, sum(b.w * q.hv) AS {name} FROM {out}_b b JOIN {out}_h q ON q.image_id = b.image_id AND q.y = b.ty AND q.x = b.x GROUP BY ALL),
{out} AS MATERIALIZED (SELECT p.*, g.{name} FROM {src} p JOIN {out}_g g USING (image_id, y, x))"""


def otsu(src: str, out: str) -> str:
    """CTE `out`: image_id, t."""
    return f"""{out}_n AS (SELECT image_id, v, count(*) AS n FROM {src} GROUP BY ALL),
{out}_c AS (SELECT image_id, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER a AS w, sum(n * v) OVER a AS s FROM {out}_n
  WINDOW u AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id)),
{out}_s AS (SELECT image_id, v, CASE WHEN w > w0 THEN round(w0::DOUBLE * (w - w0) * pow(s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0), 2), 3) ELSE -1 END AS score FROM {out}_c),
{out} AS (SELECT image_id, arg_min(v, (-score, v)) AS t FROM {out}_s GROUP BY image_id)"""


def parts(mask: str, out: str) -> str:
    """CTE `out`: image_id, y, s, e, comp (least run number) of 8-connected components of the pixels in `mask`; needs WITH RECURSIVE."""
    return f"""{out}_i AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM {mask}),
{out}_r AS MATERIALIZED (SELECT image_id, y, min(x) AS s, max(x) AS e, row_number() OVER (ORDER BY image_id, y, min(x)) AS run FROM {out}_i GROUP BY image_id, y, k),
{out}_e AS MATERIALIZED (SELECT a.run AS u, b.run AS v FROM {out}_r a JOIN {out}_r b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND b.s <= a.e + 1 AND b.e >= a.s - 1),
{out}_t AS (SELECT run, run AS root FROM {out}_r UNION SELECT e.v, t.root FROM {out}_t t JOIN {out}_e e ON e.u = t.run WHERE t.root < e.v),
{out} AS MATERIALIZED (SELECT r.*, t.comp FROM {out}_r r JOIN (SELECT run, min(root) AS comp FROM {out}_t GROUP BY run) t USING (run))"""
