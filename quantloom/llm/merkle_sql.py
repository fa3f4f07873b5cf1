"""Checking SQL of the Merkle manifest: every level a block of its own."""

from __future__ import annotations

#: Trees of up to 3 ** LEVELS documents a source, and of up to 3 ** TOPS sources.
LEVELS, TOPS = 12, 6


def levels(name: str, count: int) -> list[str]:
    """Nodes ``{name}1..`` above ``{name}0`` (k, i, h, c) and what stands left and right of each."""
    out = []
    for n in range(1, count + 1):
        below, place = f"{name}{n - 1}", "PARTITION BY k, i // 3 ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}{n} AS MATERIALIZED (SELECT k, i // 3 AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,"
            f" (any_value(c) + 2) // 3 AS c FROM {below} GROUP BY k, i // 3)"
        )
        out.append(
            f"{name}{n}_side AS MATERIALIZED (SELECT k, i, c, coalesce(string_agg(h, '') OVER ({place} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(h, '') OVER ({place} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {below})"
        )
    return out


def folds(start: str, name: str, count: int, keep: str) -> list[str]:
    """``start`` (k, i, f, p, keep) folded up the tree ``name``; the last block is ``{start}_{count}``."""
    out, before = [], start
    for n in range(1, count + 1):
        out.append(
            f"{start}_{n} AS MATERIALIZED (SELECT b.k, b.i // 3 AS i, CASE WHEN s.c > 1 THEN sha256(s.l || b.f || s.r) ELSE b.f END AS f,"
            f" b.p || s.l || s.r AS p, {keep} FROM {before} b JOIN {name}{n}_side s ON s.k = b.k AND s.i = b.i)"
        )
        before = f"{start}_{n}"
    return out


def manifest_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),"
        " lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    )
    blocks = [
        "tabs AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],"
        " lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS tab)",
        f"docs AS (SELECT *, coalesce('s' || source, 'n') AS k, {leaf('text')} AS leaf, coalesce({crc} % 2 = 0, FALSE) AS tampered FROM documents, tabs)",
        f"rows_ AS MATERIALIZED (SELECT doc_id, k, leaf, CASE WHEN tampered THEN {leaf('''replace(text, chr(10), '')''')} ELSE leaf END AS seen,"
        " row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS c FROM docs)",
        "n0 AS (SELECT k, i, leaf AS h, c FROM rows_)",
        *levels("n", LEVELS),
        f"m0 AS MATERIALIZED (SELECT 'all' AS k, k AS source, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS c FROM n{LEVELS})",
        *levels("m", TOPS),
        "f AS (SELECT k, i, seen AS f, '' AS p, doc_id, leaf FROM rows_)",
        *folds("f", "n", LEVELS, "b.doc_id, b.leaf"),
        f"g AS (SELECT m0.k, m0.i, f.f, f.p, f.doc_id, f.leaf, m0.h AS subroot FROM f_{LEVELS} f JOIN m0 ON m0.source = f.k)",
        *folds("g", "m", TOPS, "b.doc_id, b.leaf, b.subroot"),
    ]
    return (
        "WITH " + ",\n".join(blocks) + f"\nSELECT g.doc_id, g.leaf, g.subroot, t.h AS root, sha256(g.p) AS proof_sha256, g.f AS folded_root, g.f = t.h AS verified"
        f" FROM g_{TOPS} g, m{TOPS} t"
    )
