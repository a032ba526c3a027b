"""DuckDB SQL with the same rows as the queries, where SQL can express them.

None for op1 (no XXH64 with a seed), the learned op3, op7 and op9, and op10 and op13 (merge ranks
of vocabulary files): their tests compare with brute force, a library or held-out labels.
"""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM x),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
bad AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM g JOIN f USING (s) WHERE first < doc_id),
b AS (SELECT doc_id, list(i) AS gone FROM bad GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN b USING (doc_id)
"""


def _spans(kind: str, place: int, expression: str, keep: str, score: str) -> str:
    """Rows (doc_id, place, kind, a, b, score) of one kind; gaps and matches give the offsets."""
    e = expression.replace("'", "''")
    return f"""
SELECT doc_id, {place} AS place, '{kind}' AS kind, a, a + length(m) AS b, {score} AS score FROM (
  SELECT doc_id, m, text, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS a FROM (
    SELECT doc_id, text, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, text, regexp_extract_all(text, '{e}') AS ms, regexp_split_to_array(text, '{e}') AS gs FROM documents WHERE text IS NOT NULL))
) WHERE {keep}"""


def _digest(kinds: dict[str, tuple], base: list[str], scores: bool = False) -> str:
    rows = " UNION ALL ".join(_spans(k, i, e, keep, *(score or ("NULL",))) for i, (k, (e, keep, *score)) in enumerate(kinds.items()))
    text = lambda where: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place){where}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    inside = ", ".join(f"'{k}'" for k in base)
    return f"""
WITH s AS ({rows}),
r AS (SELECT doc_id, {counts}, sha256({text(f" FILTER (WHERE kind IN ({inside}))")}) AS base_sha256, {text("")} AS spans{", string_agg(CAST(score AS VARCHAR), ',' ORDER BY a, place) AS scores" if scores else ""} FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans{", coalesce(scores, '') AS scores" if scores else ""}
FROM documents LEFT JOIN r USING (doc_id)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""len({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i:
  CASE WHEN (len({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) ELSE (CAST({_DIGITS}[i] AS INT) * 2) // 10 + (CAST({_DIGITS}[i] AS INT) * 2) % 10 END)) % 10 = 0"""
_IBAN = "regexp_replace(m, ' ', '', 'g')"
_MOD97 = f"""list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c:
  CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda x, y: (x * CASE WHEN y < 10 THEN 10 ELSE 100 END + y) % 97) = 1"""



def _score(plain: float, words: str) -> str:
    """A kind's score, 0.2 more with one of the words within 48 characters."""
    around = "lower(substr(text, greatest(a + 1 - 48, 1), least(a, 48)) || ' ' || substr(text, a + length(m) + 1, 48))"
    return f"CAST(CASE WHEN regexp_matches({around}, '{words}') THEN {plain + 0.2:.1f} ELSE {plain:.1f} END AS DOUBLE)"


OP5 = _digest(
    {
        "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""len(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8"""),
        "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"),
        "hex": ("[0-9a-f]+", "length(m) >= 32"),
    },
    ["assign", "access", "hex"],
)

OP6 = _digest(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", _score(0.6, "mail|contact|write|correo|courriel")),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0", _score(0.6, "ip|host|server|address|adresse")),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", _LUHN, _score(0.8, "card|visa|credit|payment|karte|carte|tarjeta")),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15", _score(0.6, "phone|call|tel|mobile|telefon|fax")),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", _MOD97, _score(0.8, "iban|account|bank|konto|compte|cuenta")),
        "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", f"{_score(0.4, 'ssn|social security|taxpayer')} >= 0.6", _score(0.4, "ssn|social security|taxpayer")),
    },
    ["email", "ip", "card", "phone"],
    scores=True,
)

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP2 = r"""
WITH n AS (SELECT 'd' AS side, doc_id AS id, trim(lower(coalesce(text, '')), E' \t\n\x0b\f\r') AS t FROM documents
  UNION ALL SELECT 'i', item_id, trim(lower(coalesce(text, '')), E' \t\n\x0b\f\r') FROM benchmark),
w AS (SELECT side, id, regexp_split_to_array(t, '[\x20\x09-\x0D]+') AS w FROM n WHERE t <> '' AND id IS NOT NULL),
items AS (SELECT id, len(w) AS n, least(5, len(w)) AS size, w FROM w WHERE side = 'i'),
ish AS (SELECT id AS item_id, n, size, p, array_to_string(w[p:p + size - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM items)),
icount AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY 1, 2),
sizes AS (SELECT DISTINCT size FROM items),
dsh AS (SELECT id AS doc_id, len AS len, size, p, array_to_string(w[p:p + size - 1], ' ') AS s FROM
  (SELECT id, w, len(w) AS len, size, unnest(range(1, len(w) - size + 2)) AS p FROM w, sizes WHERE side = 'd' AND len(w) >= size)),
spot AS (SELECT DISTINCT d.doc_id, d.len, i.item_id, i.n, i.size, d.p - i.p + 1 AS a FROM dsh d JOIN ish i ON d.s = i.s AND d.size = i.size),
win AS (SELECT doc_id, item_id, n, size, a, greatest(a, 1) AS lo, least(a + n - 1, len) AS hi FROM spot),
hit AS (SELECT x.doc_id, x.item_id, x.a, x.lo, x.hi, x.size, x.n, d.s, count(*) AS c FROM win x JOIN dsh d ON d.doc_id = x.doc_id AND d.size = x.size AND d.p BETWEEN x.lo AND x.hi - x.size + 1
  JOIN icount k ON k.item_id = x.item_id AND k.s = d.s GROUP BY ALL),
m AS (SELECT doc_id, h.item_id, h.a, h.hi - h.lo + 2 - h.size AS wn, h.n - h.size + 1 AS inn, sum(least(h.c, k.c)) AS common FROM hit h JOIN icount k ON k.item_id = h.item_id AND k.s = h.s GROUP BY ALL)
SELECT doc_id, item_id, round(max(CAST(common AS DOUBLE) / (wn + inn - common)), 6) AS similarity FROM m GROUP BY 1, 2 HAVING max(CAST(common AS DOUBLE) / (wn + inn - common)) >= 0.8
"""

OP11 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT pos.*, p.vec_id AS negative_id, p.score AS negative_score, CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) AS INT) AS rank
  FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.alike AND 100 * p.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""

ORACLES = {"op11_ngram_join": OP11, "op12_negatives": OP12, "op2_decontamination": OP2, "op4_substring": OP4, "op5_secrets": OP5, "op6_pii": OP6, "op8_topk": OP8}
