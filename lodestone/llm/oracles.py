"""SQL of the manifest, of repeated substrings and of vector codes."""

from __future__ import annotations

# --- manifest: levels of trees, one CTE each, for up to 16 ** 7 rows a source ------------------------------------------

_DEPTH = 7


def _field(x: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: CRC-32 by bits: a byte is taken in, then eight steps (-1) follow.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, base: str) -> str:
    """CTEs {name}0 (g, place, h) from `base`, the levels above, and {name}r0... with the runs of each level."""
    out = [f"{name}0 AS MATERIALIZED ({base})"]
    for k in range(_DEPTH):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT g, place // 16 AS run, list(h ORDER BY place) AS hs, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, place // 16)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, run AS place, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")
    return ",\n".join(out)


def _fold(name: str, base: str) -> str:
    """CTEs that take rows (id, g, place, acc, proof) of `base` to the tops of their trees."""
    out = [f"{name}f0 AS MATERIALIZED ({base})"]
    for k in range(_DEPTH):
        left, right = "coalesce(array_to_string(hs[1 : f.place % 16], ''), '')", "coalesce(array_to_string(hs[f.place % 16 + 2 :], ''), '')"
        out.append(
            f"{name}f{k + 1} AS MATERIALIZED (SELECT f.id, f.g, f.place // 16 AS place, CASE WHEN n = 1 THEN acc ELSE sha256({left} || acc || {right}) END AS acc,"
            f" CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {name}f{k} f JOIN {name}r{k} r ON r.g = f.g AND r.run = f.place // 16)"
        )
    return ",\n".join(out)


MANIFEST = f"""WITH d AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS leaf, CASE WHEN coalesce({_CRC} % 5 = 0, FALSE) THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS shown FROM documents)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
{_tree('s', 'SELECT g, place, leaf AS h FROM p')},
names AS MATERIALIZED (SELECT g AS name, row_number() OVER (ORDER BY encode(g)) - 1 AS place, h FROM s{_DEPTH}),
{_tree('t', "SELECT '' AS g, place, h FROM names")},
{_fold('s', "SELECT id, g, place, shown AS acc, '' AS proof FROM p")},
{_fold('t', f"SELECT f.id, '' AS g, n.place, f.acc, f.proof FROM sf{_DEPTH} f JOIN names n ON n.name = f.g")}
SELECT d.doc_id, d.leaf, n.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = r.h AS verified
FROM d JOIN names n ON n.name = d.g JOIN tf{_DEPTH} f ON f.id = d.id CROSS JOIN t{_DEPTH} r"""

# --- repeated substrings: every window of 50 words spelt out ----------------------------------------------------------

SUBSTRINGS = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT id, doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS win FROM (SELECT id, doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win),
gone AS (SELECT DISTINCT id, unnest(range(i, i + 50)) AS pos FROM win JOIN least USING (win) WHERE first < doc_id),
word AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (id, pos) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (id)"""

# --- vector codes: Lloyd's rounds, every distance ---------------------------------------------------------------------


def _assigned(k: int) -> str:
    return f"""d{k} AS MATERIALIZED (SELECT x.id, x.part, b.entry, CAST(sum((x.z - b.z) * (x.z - b.z)) AS BIGINT) AS dist FROM x JOIN b{k} b ON b.part = x.part AND b.i = x.i GROUP BY x.id, x.part, b.entry),
a{k} AS MATERIALIZED (SELECT id, part, entry, dist FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY dist, entry) AS nth FROM d{k}) WHERE nth = 1)"""


def _moved(k: int) -> str:
    floor = "(total - ((total % n) + n) % n) // n"
    return f"""m{k} AS (SELECT a.part, a.entry, x.i, CAST(sum(x.z) AS BIGINT) AS total, count(*) AS n FROM a{k} a JOIN x ON x.id = a.id AND x.part = a.part GROUP BY a.part, a.entry, x.i),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.i, CASE WHEN n IS NULL THEN b.z ELSE {floor} END AS z FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.i = b.i)"""


VECTOR_CODES = f"""WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS zs
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT id, j // w AS part, j % w AS i, z FROM (SELECT id, len(zs) // 16 AS w, unnest(zs) AS z, unnest(range(len(zs))) AS j FROM v)),
b0 AS MATERIALIZED (SELECT part, id AS entry, i, z FROM x WHERE id < 64),
{_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
names AS (SELECT sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b2),
codes AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN codes USING (id) CROSS JOIN names"""
