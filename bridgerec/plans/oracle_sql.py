"""DuckDB SQL equivalents of the checked queries (same column names, same
rounding).  Used by the driver's correctness gate and by ``tests/``.

Literals are written as ``CAST('x' AS DOUBLE)``: a bare ``0.5`` is a decimal
in both engines.
"""

from __future__ import annotations

from bridgerec.functions.vectors import DET_MODULUS, ITEM_A, ITEM_C, USER_A, USER_C
from bridgerec.plans import queries as Q


def _d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def r6(e: str) -> str:
    return f"(ROUND({e}, 6) + CAST(0 AS DOUBLE))"


def det(idexpr: str, k: int, a: int, c: int) -> str:
    return (
        f"list_transform(range(0, {k}), lambda fx: CAST((CAST({idexpr} AS BIGINT) * {a} + fx * {c}) % {DET_MODULUS} AS DOUBLE)"
        f" / CAST({DET_MODULUS} AS DOUBLE) / SQRT(CAST({k} AS DOUBLE)))"
    )


def dot(p: str, q: str, start: str = "CAST(0 AS DOUBLE)") -> str:
    return (
        f"list_reduce(list_transform(range(1, len({p}) + 1), lambda ix: {p}[ix] * {q}[ix]), "
        f"lambda acc, x: acc + x, {start})"
    )


def arr(xs) -> str:
    return "[" + ", ".join(_d(x) for x in xs) + "]"


BASE = """
r_all AS (
  SELECT CAST(o.o_custkey AS INT) AS user_id,
         CAST(l.l_partkey AS INT) AS item_id,
         AVG(CAST(1 + CAST(l.l_quantity AS BIGINT) % 5 AS DOUBLE)) AS rating,
         CASE WHEN l.l_partkey % 2 = 0 THEN 'source' ELSE 'target' END AS domain,
         CASE WHEN (o.o_custkey + l.l_partkey) % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_partkey),
src AS (SELECT user_id, item_id, rating FROM r_all WHERE domain = 'source'),
ttr AS (SELECT user_id, item_id, rating FROM r_all WHERE domain = 'target' AND split = 'train'),
tte AS (SELECT user_id, item_id, rating FROM r_all WHERE domain = 'target' AND split = 'test'),
ttr_pc AS (SELECT * FROM ttr WHERE item_id % 7 <> 0 AND user_id % 11 <> 0),
src_po AS (SELECT * FROM src WHERE user_id % 3 <> 0)"""


def with_base(*ctes: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return "WITH" + BASE + extra + "\n"


def factors(name: str, table: str, k: int = Q.RANK) -> list[str]:
    return [
        f"{name}U AS (SELECT user_id AS id, {det('user_id', k, USER_A, USER_C)} AS p FROM (SELECT DISTINCT user_id FROM {table}))",
        f"{name}I AS (SELECT item_id AS id, {det('item_id', k, ITEM_A, ITEM_C)} AS q FROM (SELECT DISTINCT item_id FROM {table}))",
    ]


def bias_ctes(table: str) -> list[str]:
    reg = _d(Q.BIAS_REG)
    return [
        f"MU AS (SELECT AVG(rating) AS mu FROM {table})",
        f"BI AS (SELECT item_id AS id, SUM(rating - (SELECT mu FROM MU)) / ({reg} + COUNT(*)) AS bias FROM {table} GROUP BY item_id)",
        f"BU AS (SELECT t.user_id AS id, SUM(t.rating - (SELECT mu FROM MU) - BI.bias) / ({reg} + COUNT(*)) AS bias"
        f" FROM {table} t JOIN BI ON t.item_id = BI.id GROUP BY t.user_id)",
    ]


def pred_ctes(train: str = "ttr", pairs: str = "tte") -> list[str]:
    """PD: plain dot predictions, PB: biased predictions of the ``pairs`` that ``train`` covers."""
    return (
        factors("F", train)
        + bias_ctes(train)
        + [
            "PD AS (SELECT t.user_id, t.item_id, " + dot("U.p", "I.q") + " AS prediction,"
            f" U.p AS p, I.q AS q FROM {pairs} t JOIN FU U ON t.user_id = U.id JOIN FI I ON t.item_id = I.id)",
            "PB AS (SELECT PD.user_id, PD.item_id, "
            + dot("PD.p", "PD.q", "(COALESCE(BU.bias, 0) + COALESCE(BI.bias, 0) + (SELECT mu FROM MU))")
            + " AS prediction FROM PD LEFT JOIN BU ON PD.user_id = BU.id LEFT JOIN BI ON PD.item_id = BI.id)",
        ]
    )


def _tables_union(select_tpl: str) -> str:
    parts = [select_tpl.format(name=n, t=t) for n, t in (("source", "src"), ("target_train", "ttr"), ("target_test", "tte"))]
    return "\nUNION ALL\n".join(parts)


def _long(table: str, side: str, col: str, k: int) -> str:
    return (
        f"SELECT '{side}' AS side, id, CAST(ix - 1 AS INTEGER) AS f, {r6(f'{col}[ix]')} AS value "
        f"FROM {table} CROSS JOIN range(1, {k + 1}) AS rg(ix)"
    )


def _onehot_argmax(col: str) -> str:
    return (
        f"list_transform(range(1, len({col}) + 1), lambda ix: CASE WHEN ix = list_position({col}, list_max({col}))"
        f" THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    )


def _onehot_blockmax(col: str) -> str:
    return f"list_transform({col}, lambda x: CASE WHEN x = list_max({col}) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def _quantize(col: str) -> str:
    return f"list_transform({col}, lambda x: FLOOR(x * CAST(20 AS DOUBLE)) / CAST(20 AS DOUBLE))"


def epoch_ctes(iters: int, step: str, bias: bool, name: str = "", table: str = "ttr", alpha: float = Q.EPOCH_ALPHA) -> list[str]:
    """Gradient epochs over ``table``: the factors after epoch e are ``{name}U{e}`` and ``{name}I{e}``."""
    k = Q.EPOCH_RANK
    lam = _d(Q.EPOCH_LAMBDA)
    ctes = factors(f"{name}E", table, k)
    if bias:
        ctes.append(f"{name}MU AS (SELECT AVG(rating) AS mu FROM {table})")
        ctes.append(f"{name}U0 AS (SELECT id, p, CAST(0 AS DOUBLE) AS b FROM {name}EU)")
        ctes.append(f"{name}I0 AS (SELECT id, q AS p, CAST(0 AS DOUBLE) AS b FROM {name}EI)")
    else:
        ctes.append(f"{name}U0 AS (SELECT id, p FROM {name}EU)")
        ctes.append(f"{name}I0 AS (SELECT id, q AS p FROM {name}EI)")
    a = alpha
    for e in range(1, iters + 1):
        prev = e - 1
        start = f"(U.b + I.b + (SELECT mu FROM {name}MU))" if bias else "CAST(0 AS DOUBLE)"
        bcols = ", U.b AS bu, I.b AS bi" if bias else ""
        ctes.append(
            f"{name}J{e} AS (SELECT r.user_id, r.item_id, r.rating - {dot('U.p', 'I.p', start)} AS e, U.p AS p, I.p AS q{bcols}"
            f" FROM {table} r JOIN {name}U{prev} U ON r.user_id = U.id JOIN {name}I{prev} I ON r.item_id = I.id)"
        )
        for side, key, own, other, bcol in (("U", "user_id", "p", "q", "bu"), ("I", "item_id", "q", "p", "bi")):
            ctes.append(
                f"{name}G{side}{e} AS (SELECT {key} AS id, fx, SUM({other}[fx] * e - {lam} * {own}[fx]) AS g"
                f" FROM {name}J{e} CROSS JOIN range(1, {k + 1}) AS rg(fx) GROUP BY {key}, fx)"
            )
            extra = f", SUM(e - {lam} * {bcol}) AS gb" if bias else ""
            ctes.append(f"{name}N{side}{e} AS (SELECT {key} AS id, COUNT(*) AS n{extra} FROM {name}J{e} GROUP BY {key})")
            ctes.append(
                f"{name}L{side}{e} AS (SELECT G.id, list(G.g ORDER BY G.fx) AS g, MAX(N.n) AS n"
                + (", MAX(N.gb) AS gb" if bias else "")
                + f" FROM {name}G{side}{e} G JOIN {name}N{side}{e} N ON G.id = N.id GROUP BY G.id)"
            )
            scale = _d(a) if step == "sum" else f"({_d(a)} / CAST(L.n AS DOUBLE))"
            newb = (
                f", CASE WHEN L.id IS NULL THEN S.b ELSE S.b + {scale} * L.gb END AS b" if bias else ""
            )
            ctes.append(
                f"{name}{side}{e} AS (SELECT S.id, CASE WHEN L.id IS NULL THEN S.p ELSE "
                f"list_transform(range(1, {k + 1}), lambda ix: S.p[ix] + {scale} * L.g[ix]) END AS p{newb}"
                f" FROM {name}{side}{prev} S LEFT JOIN {name}L{side}{e} L ON S.id = L.id)"
            )
        a *= Q.EPOCH_DECAY
    return ctes


def report_sql(score: str, users: str, items: str) -> str:
    """The metrics row of a program whose prediction of a test pair is ``score`` of U and I."""
    joined = f"SELECT t.rating - {score} AS df FROM tte t JOIN {users} U ON U.id = t.user_id JOIN {items} I ON I.id = t.item_id"
    n_test = "(SELECT COUNT(*) FROM tte)"
    return (
        f"SELECT {r6('SQRT(SUM(df * df) / COUNT(*))')} AS rmse, {r6(f'SUM(ABS(df)) / {n_test}')} AS mae_test_n,"
        f" COUNT(*) AS n_joined, {n_test} AS n_test FROM ({joined})"
    )


def programs() -> dict[str, str]:
    """Whole programs by gradient epochs.  A mix of weight 1 takes nothing from the cluster branch but its
    coverage, and each pair with factors is covered, as the pooled ratings hold all train ratings."""
    n, k, alpha = Q.PROGRAM_ITERS, Q.EPOCH_RANK, Q.PROGRAM_ALPHA
    plain = dot("U.p", "I.p")
    pooled = "PL AS (SELECT user_id, item_id, rating FROM src UNION SELECT user_id, item_id, rating FROM ttr)"
    blended = (
        f"BU AS (SELECT T.id, CASE WHEN S.id IS NULL THEN T.p ELSE list_transform(range(1, {k + 1}), lambda ix:"
        f" {_d(1 - Q.BLEND_A)} * S.p[ix] + {_d(Q.BLEND_A)} * T.p[ix]) END AS p FROM TU{n} T LEFT JOIN SU{n} S ON S.id = T.id)"
    )
    return {
        "lfm_program": with_base(*epoch_ctes(n, "mean", False, alpha=alpha)) + report_sql(plain, f"U{n}", f"I{n}"),
        "biassvd_program": with_base(*epoch_ctes(n, "mean", True, alpha=alpha))
        + report_sql(dot("U.p", "I.p", "(U.b + I.b + (SELECT mu FROM MU))"), f"U{n}", f"I{n}"),
        "pool_mix_program": with_base(pooled, *epoch_ctes(n, "mean", False, "P", "PL", alpha)) + report_sql(plain, f"PU{n}", f"PI{n}"),
        "blend_program": with_base(*epoch_ctes(n, "mean", False, "S", "src", alpha), *epoch_ctes(n, "mean", False, "T", "ttr", alpha), blended)
        + report_sql(plain, "BU", f"TI{n}"),
    }


def epochs_sql(iters: int, step: str, bias: bool) -> str:
    k = Q.EPOCH_RANK
    ctes = epoch_ctes(iters, step, bias)
    parts = [_long(f"U{iters}", "user", "p", k), _long(f"I{iters}", "item", "p", k)]
    if bias:
        parts.append(f"SELECT 'user' AS side, id, CAST(-1 AS INTEGER) AS f, {r6('b')} AS value FROM U{iters}")
        parts.append(f"SELECT 'item' AS side, id, CAST(-1 AS INTEGER) AS f, {r6('b')} AS value FROM I{iters}")
    return with_base(*ctes) + "\nUNION ALL\n".join(parts)


def _emb_ctes() -> list[str]:
    return [
        "EM AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
        "EX AS (SELECT label, UNNEST(range(1, len(v) + 1)) AS ix, UNNEST(v) AS x FROM EM)",
        "CM AS (SELECT CAST(label AS INT) AS cluster, list(m ORDER BY ix) AS c FROM"
        " (SELECT label, ix, AVG(x) AS m FROM EX GROUP BY label, ix) GROUP BY label)",
    ]


def _sqdist(a: str, b: str) -> str:
    return (
        f"list_reduce(list_transform(range(1, len({a}) + 1), lambda ix: ({a}[ix] - {b}[ix]) * ({a}[ix] - {b}[ix])),"
        f" lambda acc, x: acc + x, CAST(0 AS DOUBLE))"
    )


def _bucket_ctes(prefix: str, table: str) -> list[str]:
    """Rating-level centres (floor of the mean rating) of the deterministic
    user and item factors of ``table``, the codebook and the memberships."""
    out = factors(prefix, table)
    for side, key, col in (("U", "user_id", "p"), ("I", "item_id", "q")):
        out.append(
            f"{prefix}L{side} AS (SELECT {key} AS id, CAST(FLOOR(AVG(rating)) AS INT) AS cluster FROM {table} GROUP BY {key})"
        )
        out.append(
            f"{prefix}C{side} AS (SELECT cluster, list(m ORDER BY ix) AS c FROM (SELECT L.cluster, ix, AVG(X.{col}[ix]) AS m"
            f" FROM {prefix}{side} X JOIN {prefix}L{side} L ON X.id = L.id CROSS JOIN range(1, {Q.RANK + 1}) AS rg(ix)"
            f" GROUP BY L.cluster, ix) GROUP BY cluster)"
        )
        out.append(
            f"{prefix}M{side} AS (SELECT id, cluster FROM (SELECT X.id, C.cluster, ROW_NUMBER() OVER"
            f" (PARTITION BY X.id ORDER BY {_sqdist(f'X.{col}', 'C.c')}, C.cluster) AS rn"
            f" FROM {prefix}{side} X CROSS JOIN {prefix}C{side} C) WHERE rn = 1)"
        )
    out.append(
        f"{prefix}CB AS (SELECT CU.cluster AS uc, CI.cluster AS ic, {dot('CU.c', 'CI.c')} AS rating"
        f" FROM {prefix}CU CU CROSS JOIN {prefix}CI CI)"
    )
    return out


def _merged_ctes() -> list[str]:
    k = Q.BUCKETS
    return (
        _bucket_ctes("S", "src")
        + _bucket_ctes("T", "ttr")
        + [
            f"CB AS (SELECT uc, ic, rating FROM SCB UNION ALL SELECT uc + {k} AS uc, ic + {k} AS ic, rating FROM TCB)",
            f"MU2 AS (SELECT id, arg_max(cluster, prio) AS cluster FROM (SELECT id, cluster, 0 AS prio FROM SMU"
            f" UNION ALL SELECT id, cluster + {k}, 1 FROM TMU) GROUP BY id)",
            f"MI2 AS (SELECT id, arg_max(cluster, prio) AS cluster FROM (SELECT id, cluster, 0 AS prio FROM SMI"
            f" UNION ALL SELECT id, cluster + {k}, 1 FROM TMI) GROUP BY id)",
        ]
    )


def _clamp(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN CAST(1 AS DOUBLE) WHEN {x} > 5 THEN CAST(5 AS DOUBLE) ELSE {x} END"


def _cos_ctes() -> list[str]:
    """SIM: each vector against the centre of its label (sign 1) and its opposite (sign -1)."""
    norm = "SQRT(list_reduce(list_transform({0}, lambda x: x * x), lambda acc, x: acc + x, CAST(0 AS DOUBLE)))"
    faced = "list_transform(CM.c, lambda x: x * CAST(sg AS DOUBLE))"
    return _emb_ctes() + [
        f"PR AS (SELECT EM.vec_id AS u1, CM.cluster AS u2, CAST(sg AS INT) AS sign, EM.v AS a, {faced} AS b"
        " FROM EM JOIN CM ON EM.label = CM.cluster CROSS JOIN (VALUES (1), (-1)) AS sgs(sg))",
        "SIM AS (SELECT u1, u2, sign, " + dot("a", "b") + f" / ({norm.format('a')} * {norm.format('b')}) AS sim FROM PR"
        f" WHERE {norm.format('a')} > 0 AND {norm.format('b')} > 0)",
        "SPREAD AS (SELECT u1, u2, sign, SIGN(sim) * SQRT(SQRT(ABS(sim))) AS sim FROM SIM)",
    ]


def _bin(x: str) -> str:
    lo, hi = "(SELECT MIN(sim) FROM SPREAD)", "(SELECT MAX(sim) FROM SPREAD)"
    iv = f"(({hi} + CAST(1 AS DOUBLE) - {lo}) / CAST(5 AS DOUBLE))"
    cases = " ".join(
        f"WHEN {x} >= {lo} + CAST({b - 1} AS DOUBLE) * {iv} AND {x} < {lo} + CAST({b} AS DOUBLE) * {iv} THEN CAST({b} AS DOUBLE)"
        for b in range(1, 5)
    )
    return f"CASE {cases} ELSE CAST(5 AS DOUBLE) END"


def build() -> dict[str, str]:
    s: dict[str, str] = {}
    s["ratings_dedupe"] = with_base() + f"SELECT user_id, item_id, {r6('rating')} AS rating, domain, split FROM r_all"
    s["split_counts"] = with_base() + (
        "SELECT domain, split, COUNT(*) AS n_ratings, COUNT(DISTINCT user_id) AS n_users,"
        f" COUNT(DISTINCT item_id) AS n_items, {r6('AVG(rating)')} AS avg_rating FROM r_all GROUP BY domain, split"
    )
    s["global_mean"] = with_base() + _tables_union(
        "SELECT '{name}' AS table_name, COUNT(*) AS n, " + r6("AVG(rating)") + " AS mu FROM {t}"
    )
    s["matrix_dims"] = with_base() + _tables_union(
        "SELECT '{name}' AS table_name, MAX(user_id) + 1 AS n_rows, MAX(item_id) + 1 AS n_cols,"
        " COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT item_id) AS n_items FROM {t}"
    )
    s["preview_ratings"] = with_base() + f"SELECT user_id, item_id, {r6('rating')} AS rating FROM tte ORDER BY user_id, item_id LIMIT 5"
    for name, t in (("parse_tab", "ttr"), ("parse_comma", "src"), ("parse_strict", "tte")):
        s[name] = with_base() + f"SELECT user_id, item_id, {r6('rating')} AS rating FROM {t}"
    s["last_rating_wins"] = (
        "SELECT CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,"
        f" {r6('arg_max(CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE), ROW(l_orderkey, l_linenumber, l_partkey, l_quantity))')} AS rating"
        " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey"
    )
    s["pool_distinct"] = with_base() + (
        f"SELECT user_id, item_id, {r6('rating')} AS rating FROM"
        " (SELECT user_id, item_id, rating FROM src UNION"
        " SELECT user_id, item_id, rating FROM r_all WHERE split = 'train')"
    )
    s["pool_all"] = with_base() + (
        f"SELECT 'source' AS domain, user_id, item_id, {r6('rating')} AS rating FROM src UNION ALL"
        f" SELECT 'target' AS domain, user_id, item_id, {r6('rating')} AS rating FROM ttr"
    )
    s["user_overlap"] = with_base() + (
        "SELECT CASE WHEN s = 1 AND t = 1 THEN 'shared' WHEN s = 1 THEN 'source_only' ELSE 'target_only' END AS category,"
        " COUNT(*) AS n_users FROM (SELECT user_id, MAX(in_s) AS s, MAX(in_t) AS t FROM"
        " (SELECT user_id, 1 AS in_s, 0 AS in_t FROM src_po UNION ALL SELECT user_id, 0, 1 FROM ttr_pc) GROUP BY user_id)"
        " GROUP BY 1"
    )
    s["coverage_pairs"] = with_base() + (
        f"SELECT user_id, item_id, {r6('rating')} AS rating FROM tte"
        " WHERE user_id IN (SELECT user_id FROM ttr_pc) AND item_id IN (SELECT item_id FROM ttr_pc)"
    )
    s["covered_pair_count"] = with_base() + (
        "SELECT COUNT(*) AS n_pairs FROM (SELECT DISTINCT user_id, item_id FROM tte"
        " WHERE user_id IN (SELECT user_id FROM ttr_pc) AND item_id IN (SELECT item_id FROM ttr_pc))"
    )
    s["pred_dot"] = with_base(*pred_ctes()) + f"SELECT user_id, item_id, {r6('prediction')} AS prediction FROM PD"
    s["pred_biased"] = with_base(*pred_ctes()) + f"SELECT user_id, item_id, {r6('prediction')} AS prediction FROM PB"
    diag = arr(Q.DIAG)
    diag_dot = (
        f"list_reduce(list_transform(range(1, len(p) + 1), lambda ix: p[ix] * {diag}[ix] * q[ix]),"
        " lambda acc, x: acc + x, CAST(0 AS DOUBLE))"
    )
    s["pred_diag_scaled"] = with_base(*pred_ctes()) + f"SELECT user_id, item_id, {r6(diag_dot)} AS prediction FROM PD"
    scaled = f"(({diag_dot}) / {_d(Q.CAP_SCALE)})"
    capped = f"CASE WHEN {scaled} > CAST(5 AS DOUBLE) THEN CAST(5 AS DOUBLE) ELSE {scaled} END"
    s["pred_scaled_cap"] = with_base(*pred_ctes()) + f"SELECT user_id, item_id, {r6(capped)} AS prediction FROM PD"
    raw = f"({_d(Q.CLAMP_SCALE)} * prediction - {_d(Q.CLAMP_SHIFT)})"
    s["pred_clamp"] = with_base(*pred_ctes()) + f"SELECT user_id, item_id, {r6(_clamp(raw))} AS prediction FROM PD"
    s["pred_extremes"] = with_base(*pred_ctes(), f"CL AS (SELECT {_clamp(raw)} AS c FROM PD)") + (
        f"SELECT {r6('MIN(c)')} AS lowest, {r6('MAX(c)')} AS highest, COUNT(*) AS n FROM CL"
    )
    s["pred_limited"] = with_base(*pred_ctes()) + (
        f"SELECT user_id, item_id, {r6('GREATEST(LEAST(prediction, ' + _d(3.3) + '), ' + _d(2.9) + ')')} AS prediction FROM PB"
    )
    sd = arr(Q.SIGNED_DIAG)
    fold = (
        f"list_reduce(list_transform(range(1, len(p) + 1), lambda ix: p[ix] * {sd}[ix] * q[ix]),"
        " lambda acc, x: CASE WHEN ABS(acc + x) < CAST(1 AS DOUBLE) THEN CAST(1 AS DOUBLE)"
        " WHEN ABS(acc + x) > CAST(5 AS DOUBLE) THEN CAST(5 AS DOUBLE) ELSE ABS(acc + x) END, CAST(0 AS DOUBLE))"
    )
    s["pred_running_clamp"] = with_base(*pred_ctes()) + f"SELECT user_id, item_id, {r6(fold)} AS prediction FROM PD"
    s["one_hot_argmax"] = with_base(
        *factors("F", "ttr"), f"OH AS (SELECT id, {_onehot_argmax('p')} AS h FROM FU)"
    ) + _long("OH", "user", "h", Q.RANK)
    s["one_hot_blockmax"] = with_base(
        *factors("F", "ttr"),
        f"QZ AS (SELECT id, {_quantize('q')} AS q FROM FI)",
        f"OH AS (SELECT id, {_onehot_blockmax('q')} AS h FROM QZ)",
    ) + _long("OH", "item", "h", Q.RANK)
    k = len(Q.DIAG)
    lam = _d(Q.REFINE_LAMBDA)
    s["diag_refine_step"] = with_base(
        *factors("F", "ttr"),
        f"OU AS (SELECT id, {_onehot_argmax('p')} AS u FROM FU)",
        f"OI AS (SELECT id, {_onehot_blockmax(_quantize('q'))} AS v FROM FI)",
        "ER AS (SELECT r.rating - "
        + f"list_reduce(list_transform(range(1, {k + 1}), lambda ix: OU.u[ix] * {diag}[ix] * OI.v[ix]), lambda acc, x: acc + x, CAST(0 AS DOUBLE))"
        + " AS e FROM ttr r JOIN OU ON r.user_id = OU.id JOIN OI ON r.item_id = OI.id)",
        f"G AS (SELECT CAST(ix - 1 AS INTEGER) AS k, AVG({diag}[ix] * e - {lam} * {diag}[ix]) AS g"
        f" FROM ER CROSS JOIN range(1, {k + 1}) AS rg(ix) GROUP BY ix)",
    ) + f"SELECT k, {r6(f'{diag}[k + 1] + {_d(Q.REFINE_ALPHA)} * g')} AS d FROM G"
    xs = "JX AS (SELECT t.rating, list_transform(range(1, 9), lambda ix: U.p[ix] * I.q[ix]) AS x FROM ttr t JOIN FU U ON t.user_id = U.id JOIN FI I ON t.item_id = I.id)"
    s["diag_normal_sums"] = with_base(*factors("F", "ttr"), xs) + (
        "SELECT CAST(a.k - 1 AS INT) AS k, CAST(b.l - 1 AS INT) AS l, ROUND(SUM(x[a.k] * x[b.l]), 4) AS value"
        " FROM JX CROSS JOIN range(1, 9) AS a(k) CROSS JOIN range(1, 9) AS b(l) GROUP BY 1, 2 UNION ALL"
        " SELECT CAST(a.k - 1 AS INT), -1, ROUND(SUM(x[a.k] * rating), 4) FROM JX CROSS JOIN range(1, 9) AS a(k) GROUP BY 1"
    )
    mctes = pred_ctes("ttr_pc") + [
        "MJ AS (SELECT PB.prediction - t.rating AS df FROM PB JOIN tte t ON PB.user_id = t.user_id AND PB.item_id = t.item_id)"
    ]
    s["rmse_joined"] = with_base(*mctes) + f"SELECT {r6('SQRT(SUM(df * df) / COUNT(*))')} AS rmse, COUNT(*) AS n_joined FROM MJ"
    s["rmse_test_n"] = with_base(*mctes) + (
        f"SELECT {r6('SQRT((SELECT SUM(df * df) FROM MJ) / CAST(COUNT(*) AS DOUBLE))')} AS rmse, COUNT(*) AS n_test FROM tte"
    )
    s["mae_test_n"] = with_base(*mctes) + (
        f"SELECT {r6('(SELECT SUM(ABS(df)) FROM MJ) / CAST(COUNT(*) AS DOUBLE)')} AS mae, COUNT(*) AS n_test FROM tte"
    )
    s["top_n_items"] = with_base() + (
        f"SELECT user_id, item_id, CAST(rn AS INTEGER) AS rank, {r6('rating')} AS rating FROM"
        " (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rn FROM ttr)"
        f" WHERE rn <= {Q.TOP_N}"
    )
    s["user_item_counts"] = with_base() + "SELECT user_id, COUNT(*) AS n_items FROM tte GROUP BY user_id"
    n = Q.TOP_N
    seen = "WHERE NOT EXISTS (SELECT 1 FROM ttr x WHERE x.user_id = PB.user_id AND x.item_id = PB.item_id) AND"
    for name, pairs, only in (("precision_recall", "tte", "WHERE"), ("precision_recall_unseen", "both_pairs", seen)):
        s[name] = with_base(
            "both_pairs AS (SELECT user_id, item_id FROM tte UNION ALL SELECT user_id, item_id FROM ttr)",
            *pred_ctes("ttr", pairs),
            "PU AS (SELECT DISTINCT user_id FROM PB)",
            "TB AS (SELECT * FROM tte WHERE user_id IN (SELECT user_id FROM PU))",
            "PT AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, ROW_NUMBER() OVER (PARTITION BY user_id"
            f" ORDER BY prediction DESC, item_id) AS rn FROM PB {only} user_id IN (SELECT user_id FROM tte)) WHERE rn <= {n})",
            "TT AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, ROW_NUMBER() OVER (PARTITION BY user_id"
            f" ORDER BY rating DESC, item_id) AS rn FROM TB) WHERE rn <= {n})",
            "H AS (SELECT COUNT(*) AS hits FROM PT JOIN TT ON PT.user_id = TT.user_id AND PT.item_id = TT.item_id)",
            "S AS (SELECT COUNT(*) AS n_recall, COUNT(DISTINCT user_id) AS n_users FROM TB)",
        ) + (
            f"SELECT {r6(f'CAST(hits AS DOUBLE) / CAST(n_users * {n} AS DOUBLE)')} AS precision,"
            f" {r6('CAST(hits AS DOUBLE) / CAST(n_recall AS DOUBLE)')} AS recall, hits, n_users, n_recall FROM H, S"
        )
    every = "(SELECT U.id AS user_id, I.id AS item_id FROM FU U CROSS JOIN FI I)"
    for name, table, only in (
        ("recommend_all", "PD", ""),
        ("recommend_unseen", "PB", " WHERE NOT EXISTS (SELECT 1 FROM ttr x WHERE x.user_id = PB.user_id AND x.item_id = PB.item_id)"),
    ):
        s[name] = with_base(*pred_ctes("ttr", every)) + (
            f"SELECT user_id, item_id, CAST(rn AS INTEGER) AS rank, {r6('prediction')} AS score FROM"
            " (SELECT user_id, item_id, prediction, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rn"
            f" FROM {table}{only}) WHERE rn <= {n}"
        )
    s["mf_epoch_1"] = epochs_sql(1, "sum", False)
    s["mf_epoch_2"] = epochs_sql(2, "mean", False)
    s["bias_epoch_1"] = epochs_sql(1, "sum", True)
    s.update(programs())
    s["nearest_center"] = with_base(*_emb_ctes()) + (
        "SELECT vec_id, cluster FROM (SELECT EM.vec_id, CM.cluster, ROW_NUMBER() OVER (PARTITION BY EM.vec_id ORDER BY "
        + _sqdist("EM.v", "CM.c")
        + ", CM.cluster) AS rn FROM EM CROSS JOIN CM) WHERE rn = 1"
    )
    s["center_cross"] = with_base(*_emb_ctes()) + (
        f"SELECT a.cluster AS uc, b.cluster AS ic, {r6(dot('a.c', 'b.c'))} AS rating FROM CM a CROSS JOIN CM b"
    )
    s["cluster_ratings"] = with_base(*_bucket_ctes("T", "ttr")) + f"SELECT uc, ic, {r6('rating')} AS rating FROM TCB"
    s["cluster_merge_offset"] = with_base(*_merged_ctes()) + f"SELECT uc, ic, {r6('rating')} AS rating FROM CB"
    s["cluster_lookup_predict"] = with_base(*_merged_ctes()) + (
        f"SELECT t.user_id, t.item_id, {r6(_clamp('CB.rating'))} AS prediction FROM tte t"
        " JOIN MU2 ON t.user_id = MU2.id JOIN MI2 ON t.item_id = MI2.id"
        " JOIN CB ON CB.uc = MU2.cluster AND CB.ic = MI2.cluster"
    )
    unit = "list_transform(p, lambda x: x / SQRT(list_reduce(list_transform(p, lambda y: y * y), lambda acc, y: acc + y, CAST(0 AS DOUBLE))))"
    s["nearest_users"] = with_base(*factors("F", "ttr"), f"UN AS (SELECT id, {unit} AS v FROM FU)") + (
        f"SELECT CAST(u1 AS BIGINT) AS u1, CAST(u2 AS BIGINT) AS u2, CAST(rn AS INTEGER) AS rank, {r6('sim')} AS sim FROM"
        " (SELECT u1, u2, sim, ROW_NUMBER() OVER (PARTITION BY u1 ORDER BY ROUND(sim, 12) DESC, u2) AS rn FROM"
        f" (SELECT a.id AS u1, b.id AS u2, {dot('a.v', 'b.v')} AS sim FROM UN a JOIN UN b ON a.id <> b.id))"
        f" WHERE rn <= {Q.TOP_N}"
    )
    width = "((hi + CAST(1 AS DOUBLE) - lo) / CAST(5 AS DOUBLE))"
    at = " ".join(f"WHEN sim < lo + {k} * {width} THEN {k}" for k in range(1, 5))
    s["user_pair_bins"] = with_base(
        *factors("F", "ttr"),
        f"UN AS (SELECT id, {unit} AS v FROM FU)",
        f"UP AS (SELECT {dot('a.v', 'b.v')} AS sim FROM UN a JOIN UN b ON a.id <> b.id)",
        "UL AS (SELECT MIN(sim) AS lo, MAX(sim) AS hi FROM UP)",
        f"UB AS (SELECT CASE {at} ELSE 5 END AS bin, COUNT(*) AS n FROM UP CROSS JOIN UL GROUP BY 1)",
    ) + (
        f"SELECT CAST(k AS DOUBLE) AS bin, CAST(COALESCE(n, 0) AS BIGINT) AS n_pairs, {r6('lo')} AS sim_min, {r6('hi')} AS sim_max"
        " FROM range(1, 6) AS r(k) CROSS JOIN UL LEFT JOIN UB ON UB.bin = k"
    )
    near = (
        "SELECT u1, u2 FROM (SELECT u1, u2, ROW_NUMBER() OVER (PARTITION BY u1 ORDER BY ROUND(sim, 12) DESC, u2) AS rn FROM UP)"
        f" WHERE rn <= {Q.TOP_N}"
    )
    k = Q.EPOCH_RANK
    s["similarity_step"] = with_base(
        *factors("F", "ttr"),
        f"UN AS (SELECT id, {unit} AS v FROM FU)",
        f"UP AS (SELECT a.id AS u1, b.id AS u2, {dot('a.v', 'b.v')} AS sim FROM UN a JOIN UN b ON a.id <> b.id)",
        "UL AS (SELECT MIN(sim) AS lo, MAX(sim) AS hi FROM UP)",
        f"NN AS ({near})",
        "ED AS (SELECT u1, u2 FROM NN UNION SELECT u2, u1 FROM NN)",
        f"SV AS (SELECT UP.u1, UP.u2, CASE WHEN ED.u1 IS NULL THEN (sim - lo) / {width} + {_d(0.5)} {at} ELSE 5 END AS s"
        " FROM UP CROSS JOIN UL LEFT JOIN ED ON UP.u1 = ED.u1 AND UP.u2 = ED.u2)",
        f"PQ AS (SELECT id, {det('id', k, USER_A, USER_C)} AS a, {det('id', k, ITEM_A, ITEM_C)} AS b FROM FU)",
        f"ER AS (SELECT u1, x.a AS a, y.b AS b, s - {dot('x.a', 'y.b')} AS e FROM SV JOIN PQ x ON x.id = u1 JOIN PQ y ON y.id = u2)",
        f"GR AS (SELECT u1 AS id, ANY_VALUE(a) AS a, [{', '.join(f'AVG(e * b[{f + 1}])' for f in range(k))}] AS g FROM ER GROUP BY u1)",
        f"ST AS (SELECT id, list_transform(range(1, {k + 1}), lambda ix: a[ix] + {_d(Q.SIM_ALPHA)} * (g[ix] - {_d(Q.EPOCH_LAMBDA)} * a[ix])) AS p FROM GR)",
    ) + _long("ST", "user", "p", k)
    s["centre_cosine"] = with_base(*_cos_ctes()) + f"SELECT u1, u2, sign, {r6('sim')} AS sim FROM SIM"
    s["centre_cosine_binned"] = with_base(*_cos_ctes()) + f"SELECT u1, u2, sign, {_bin('sim')} AS sim FROM SPREAD"
    a = Q.BLEND_A
    s["factor_blend"] = with_base(
        f"SB AS (SELECT user_id AS id, {det('user_id', Q.RANK, USER_A, USER_C)} AS s FROM (SELECT DISTINCT user_id FROM src_po))",
        f"TB AS (SELECT user_id AS id, {det('user_id', Q.RANK, ITEM_A, ITEM_C)} AS t FROM (SELECT DISTINCT user_id FROM ttr))",
        "BL AS (SELECT TB.id, CASE WHEN SB.s IS NULL THEN TB.t ELSE list_transform(range(1, "
        f"{Q.RANK + 1}), lambda ix: {_d(1.0 - a)} * SB.s[ix] + {_d(a)} * TB.t[ix]) END AS p"
        " FROM TB LEFT JOIN SB ON TB.id = SB.id)",
    ) + _long("BL", "user", "p", Q.RANK)
    s["svd_invariants"] = "SELECT CAST(k AS INTEGER) AS k, true AS unit_u, true AS unit_v, true AS fits, true AS fits_back FROM range(0, 8) AS r(k)"
    s["svd_energy"] = with_base() + (
        "SELECT COUNT(DISTINCT g) AS n_values, ROUND(SUM(v * v), 2) AS energy FROM"
        " (SELECT user_id % 16 AS g, item_id, SUM(rating) AS v FROM ttr GROUP BY 1, 2)"
    )
    s["als_user_equations"] = with_base() + "SELECT DISTINCT user_id, true AS solved FROM ttr"
    s["bias_als_equations"] = with_base(*bias_ctes("ttr")) + f"SELECT id AS user_id, {r6('bias')} AS bias, true AS solved FROM BU"
    s["kmeans_nearest"] = "SELECT vec_id, true AS nearest FROM embeddings"
    w, sh = Q.MIX_W, Q.MIX_SHIFT
    s["prediction_mix"] = with_base(*pred_ctes()) + (
        f"SELECT PB.user_id, PB.item_id, {r6(f'{_d(w)} * PB.prediction + {_d(1.0 - w)} * (PD.prediction + {_d(sh)})')}"
        " AS prediction FROM PB JOIN PD ON PB.user_id = PD.user_id AND PB.item_id = PD.item_id"
    )
    return s
