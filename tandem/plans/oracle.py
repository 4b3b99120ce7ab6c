"""The fixtures in DuckDB SQL, as common table expressions to put before an oracle's own."""

from __future__ import annotations

CTES = {
    "samples": """samples AS (SELECT user_id // 2 AS recording_id, CAST(user_id % 2 AS INT) AS role, epoch_us(ts) AS t,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS val, event_type AS kind FROM events)""",
    "sparse": """sparse AS (SELECT recording_id, role, CASE WHEN idx % 13 <> 0 THEN t // 21600000000 * 21600000000 END AS t, idx, val, kind
      FROM samples WHERE NOT (role = 1 AND recording_id % 7 = 0))""",
    "grid": """grid AS (SELECT recording_id, CAST(unnest(range(greatest(720, hours // 1 + 1))) AS INT) AS frame
      FROM (SELECT DISTINCT user_id // 2 AS recording_id FROM events), (SELECT max(epoch_us(ts) // 3600000000 - 473352) AS hours FROM events))""",
    "frames": """frames AS MATERIALIZED (SELECT g.recording_id, role, g.frame, c.val, coalesce(c.n, 0) AS n
      FROM grid g CROSS JOIN (VALUES (0), (1)) x(role) LEFT JOIN (
        SELECT user_id // 2 AS recording_id, user_id % 2 AS role, epoch_us(ts) // 3600000000 - 473352 AS frame, round(sum(value), 6) AS val, count(*) AS n FROM events GROUP BY ALL
      ) c USING (recording_id, role, frame))""",
    "grid6": """grid6 AS (SELECT recording_id, CAST(unnest(range(greatest(120, hours // 6 + 1))) AS INT) AS frame
      FROM (SELECT DISTINCT user_id // 2 AS recording_id FROM events), (SELECT max(epoch_us(ts) // 3600000000 - 473352) AS hours FROM events))""",
    "frames6": """frames6 AS MATERIALIZED (SELECT g.recording_id, role, g.frame, c.val, coalesce(c.n, 0) AS n
      FROM grid6 g CROSS JOIN (VALUES (0), (1)) x(role) LEFT JOIN (
        SELECT user_id // 2 AS recording_id, user_id % 2 AS role, (epoch_us(ts) // 3600000000 - 473352) // 6 AS frame, round(sum(value), 6) AS val, count(*) AS n FROM events GROUP BY ALL
      ) c USING (recording_id, role, frame))""",
    "intervals": """intervals AS (SELECT user_id // 2 AS recording_id, event_id AS iv, CAST(epoch_us(ts) // 3600000000 - 473352 AS INT) AS start_frame,
      CAST(epoch_us(ts) // 3600000000 - 473352 + 1 + event_id % 4 AS INT) AS end_frame, CAST(event_id % 2 AS INT) AS initiator,
      CAST(event_id % 3 AS INT) AS cue, event_id % 11 = 0 AS skip FROM events WHERE event_type = 'purchase')""",
    "poses": """poses AS (SELECT CAST(label AS BIGINT) AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id,
      CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
      embedding[4]::DOUBLE / nrm AS qx, embedding[5]::DOUBLE / nrm AS qy, embedding[6]::DOUBLE / nrm AS qz, embedding[7]::DOUBLE / nrm AS qw
      FROM (SELECT *, sqrt(embedding[4]::DOUBLE ** 2 + embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2 + embedding[7]::DOUBLE ** 2) AS nrm FROM embeddings))""",
    "words": r"""words AS (SELECT conv_id AS recording_id, turn, role, pos - 1 AS pos, word, turn * 600 + (pos - 1) * 4 AS start, turn * 600 + (pos - 1) * 4 + 3 AS "end"
      FROM (SELECT conv_id, turn, role, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT *, string_split_regex(text, '\s+') AS w FROM conversations)) WHERE word <> '')""",
    "boxes": """boxes AS (SELECT l_orderkey AS frame, l_linenumber AS slot, CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST(l_suppkey % 400 AS DOUBLE) AS y0,
      l_partkey % 600 + l_quantity * 4 AS x1, l_suppkey % 400 + l_quantity * 3 AS y1, 1 - l_discount AS conf, l_returnflag AS name FROM lineitem)""",
    "contact": """contact AS (SELECT user_id // 2 AS recording_id, user_id AS person, epoch_us(ts) AS t, CAST(event_id % 5 AS INT) AS object,
      CASE event_type WHEN 'click' THEN 'grasp' ELSE 'release' END AS kind, event_id FROM events WHERE event_type IN ('click', 'view'))""",
    "scores": """scores AS (SELECT doc_id, quality AS y, CAST(n_chars AS DOUBLE) AS score, source AS group_id FROM labels JOIN documents USING (doc_id))""",
    "files": """files AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size, md5(text) AS hash FROM documents)""",
    "disk": """disk0 AS (SELECT doc_id, path, size, CASE WHEN doc_id % 19 = 0 THEN md5(hash) ELSE hash END AS hash FROM files WHERE doc_id % 17 <> 0),
      disk AS (SELECT * FROM disk0 UNION ALL SELECT doc_id, path || '.tmp', size, hash FROM disk0 WHERE doc_id % 23 = 0)""",
    "verdicts": """verdicts AS (SELECT user_id AS id, event_type AS item, user_id % 4 AS stream,
      CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong' ELSE 'unsure' END AS verdict, epoch_us(ts) AS t, event_id FROM events)""",
    "chunks": """chunks AS (SELECT o_custkey AS camera, o_orderkey AS chunk, CASE WHEN o_orderkey % 29 <> 0 THEN epoch_us(o_orderdate) // 86400000000 * 86400 END AS start,
      CASE WHEN o_orderkey % 29 <> 0 THEN epoch_us(o_orderdate) // 86400000000 * 86400 + CAST(floor(o_totalprice) AS BIGINT) END AS "end" FROM orders)""",
}
NEEDS = {"sparse": ["samples"], "frames": ["grid"], "frames6": ["grid6"], "disk": ["files"]}


def sql(fixtures: str, body: str) -> str:
    """`body` (either further `name AS (...)` and a SELECT, or a SELECT alone) after the named fixtures."""
    out: list[str] = []
    for f in fixtures.split():
        out += [x for x in [*NEEDS.get(f, []), f] if x not in out]
    head = "WITH " + ",\n".join(CTES[f] for f in out)
    body = body.strip()
    return f"{head}\n{body}" if body.upper().startswith("SELECT") else f"{head},\n{body}"


def recursive(text: str) -> str:
    """The same with expressions that may refer to themselves."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def nearest_to_rays(rays: str) -> str:
    """The point nearest to all rays (ox.., ux.. of length 1, w) of each recording_id and part, by Cramer's rule."""
    sums = [f"sum(w * ({int(i == j)} - u{a} * u{b})) AS m{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")] + [f"sum(w * (o{a} - u{a} * (ux * ox + uy * oy + uz * oz))) AS v{i}" for i, a in enumerate("xyz")]
    minor = lambda a, b, c, d: f"({a} * {b} - {c} * {d})"
    det = lambda c: f"{c[0][0]} * {minor(c[1][1], c[2][2], c[1][2], c[2][1])} - {c[0][1]} * {minor(c[1][0], c[2][2], c[1][2], c[2][0])} + {c[0][2]} * {minor(c[1][0], c[2][1], c[1][1], c[2][0])}"
    m = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    put = lambda k: [[f"v{i}" if j == k else m[i][j] for j in range(3)] for i in range(3)]
    cols = ", ".join(f"round(CASE WHEN n >= 2 AND abs(det) > 1e-9 THEN ({det(put(k))}) / det END, 3) AS {c}" for k, c in enumerate("xyz"))
    return f"{rays},\ns AS (SELECT recording_id, part, count(*) AS n, {', '.join(sums)} FROM r GROUP BY ALL), d AS (SELECT *, {det(m)} AS det FROM s) SELECT recording_id, part, n, {cols} FROM d"
