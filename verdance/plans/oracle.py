"""DuckDB SQL for the queries over the driver model, written independently of the operators."""

from __future__ import annotations

BINS = ["MAF_le_0.01", "0.01_lt_MAF_le_0.05", "0.05_lt_MAF_le_0.10", "MAF_gt_0.10"]
ALT = ["AC_eq_1", "AC_2_to_5", "AF_le_0.01", "0.01_lt_AF_le_0.05", "0.05_lt_AF_le_0.10", "AF_gt_0.10"]
GROUPS = ["Ex_situ", "Pingshun", "Tongguan", "Zhendong"]
GARDENS = GROUPS[1:]
REGIONS = ["AFRICA", "AMERICA", "MIDDLE EAST"]
PLANS = {"Greedy_Plan_A": (1, 2, 1), "Greedy_Plan_B": (3, 3, 3)}


def values(name: str, cols: str, rows: list) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({cols}))"


def _in(g: str) -> str:
    return f"material = '{g}'" if g in ("Wild", "Ex_situ") else f"garden = '{g}'"


_WIDE = ", ".join(f"CAST(coalesce(sum(ac) FILTER ({_in(g)}), 0) AS BIGINT) AS {g}_AC, CAST(coalesce(sum(an) FILTER ({_in(g)}), 0) AS BIGINT) AS {g}_AN" for g in ["Wild", *GROUPS])
_COPIES = ", ".join(f"CASE WHEN minor = 'ALT' THEN {g}_AC ELSE {g}_AN - {g}_AC END AS n_{g}" for g in GROUPS)

BASE = f"""WITH RECURSIVE m AS (SELECT greatest(200, count(*) // 10) AS m FROM part),
samples AS (SELECT 'S' || s_suppkey AS sample_id, CAST(s_suppkey AS INTEGER) AS ord, CASE WHEN n_regionkey IN (0, 1, 4) THEN 'Wild' ELSE 'Ex_situ' END AS material,
    CASE WHEN n_regionkey = 2 THEN 'Pingshun' WHEN n_regionkey = 3 AND n_nationkey % 2 = 0 THEN 'Tongguan' WHEN n_regionkey = 3 THEN 'Zhendong' ELSE 'NA' END AS garden,
    CASE WHEN n_regionkey IN (0, 1, 4) THEN r_name ELSE 'NA' END AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey < 100),
raw AS (SELECT l_partkey % m AS p, CAST(l_suppkey % 100 AS INTEGER) AS ord, l_quantity, l_tax, l_discount,
    row_number() OVER (PARTITION BY l_partkey % m, l_suppkey % 100 ORDER BY l_orderkey, l_linenumber, l_discount, l_quantity, l_tax) AS rn FROM lineitem, m),
alle AS (SELECT p, ord, rn, l_quantity, l_tax, CASE
    WHEN p % 23 = 0 THEN CASE WHEN l_discount >= 0.05 AND l_quantity <= 1 + p % 10 THEN 0 ELSE 1 END
    WHEN l_discount >= 0.05 AND l_quantity <= CASE WHEN p % 10 = 9 THEN 20 ELSE p % 10 END THEN 1 ELSE 0 END AS a FROM raw WHERE rn <= 2),
calls AS (SELECT p, 'chr' || (p % 5) AS chrom, CAST(p AS VARCHAR) AS pos, sample_id, material, garden, region, ord, max(a) FILTER (rn = 1) AS a1, max(a) FILTER (rn = 2) AS a2,
    CAST(max(l_quantity) FILTER (rn = 1) AS DOUBLE) AS dp, CAST(round(max(l_tax) FILTER (rn = 1) * 100) * 10 AS DOUBLE) AS gq
    FROM alle JOIN samples USING (ord) GROUP BY ALL),
cnt AS (SELECT *, a1 + coalesce(a2, 0) AS ac, CASE WHEN a2 IS NULL THEN 1 ELSE 2 END AS an FROM calls),
wide AS (SELECT chrom, pos, {_WIDE} FROM cnt GROUP BY chrom, pos),
u0 AS (SELECT *, CASE WHEN Wild_AC * 2 <= Wild_AN THEN 'ALT' ELSE 'REF' END AS minor, least(Wild_AC, Wild_AN - Wild_AC) AS mc FROM wide WHERE Wild_AC > 0 AND Wild_AC < Wild_AN),
uni AS (SELECT *, mc / Wild_AN AS maf, CASE WHEN mc / Wild_AN <= 0.01 THEN '{BINS[0]}' WHEN mc / Wild_AN <= 0.05 THEN '{BINS[1]}' WHEN mc / Wild_AN <= 0.10 THEN '{BINS[2]}' ELSE '{BINS[3]}' END AS bin, {_COPIES} FROM u0),
miss AS (SELECT * FROM uni WHERE n_Ex_situ = 0),
{values("bins", "bin, bo", [(b, i) for i, b in enumerate(BINS)])},
allbins AS (SELECT bin FROM bins UNION ALL SELECT 'All'),
{values("th", "t, tmin", [("all", 1), ("AC_ge_2", 2), ("AC_ge_3", 3)])},
{values("gr", "g", GROUPS)},
{values("rg", "region", REGIONS)},
{values("q0", "plan, region, q, ro", [(p, r, n, i) for p, qs in PLANS.items() for i, (r, n) in enumerate(zip(REGIONS, qs))])},
rsize AS (SELECT region, count(*) AS n FROM samples WHERE material = 'Wild' AND region IN ('AFRICA', 'AMERICA', 'MIDDLE EAST') GROUP BY region),
quota AS (SELECT plan, region, CAST(least(q, n) AS INTEGER) AS q, ro FROM q0 JOIN rsize USING (region)),
held AS (SELECT bin, mc, g, CASE g {' '.join(f"WHEN '{g}' THEN n_{g}" for g in GROUPS)} END AS n FROM uni, gr)
"""


def rnd(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 9)"


def share(a: str, b: str) -> str:
    return rnd(f"CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END")


def share0(a: str, b: str) -> str:
    return rnd(f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END")


def q(body: str, *ctes: str) -> str:
    return BASE + "".join(f", {c}" for c in ctes) + "\n" + body


_RET = f"n AS Wild_minor_alleles, k AS Retained_Wild_minor_alleles, n - k AS Missing_Wild_minor_alleles, {share('k', 'n')} AS Minor_allele_retention_rate, {share('n - k', 'n')} AS Missing_rate"
_THR = f"n AS Total_Wild_SNP_minor_alleles, x AS Missing_in_all_Ex_situ, n - x AS Retained_in_Ex_situ, {share('n - x', 'n')} AS Retention_rate, {share('x', 'n')} AS Missing_rate"
_BY_SITE = """ps AS (SELECT *, CASE WHEN n_Tongguan > 0 AND n_Zhendong > 0 THEN 'Both_TG_RG_and_ZD_RG' WHEN n_Tongguan > 0 THEN 'TG_RG_only' WHEN n_Zhendong > 0 THEN 'ZD_RG_only' ELSE 'Still_missing_from_all_ex_situ' END AS cls FROM uni WHERE n_Pingshun = 0)"""
_OCC = [
    "reg AS (SELECT s.chrom, s.pos, r.region, coalesce(sum(CASE WHEN minor = 'ALT' THEN c.ac ELSE c.an - c.ac END), 0) AS n FROM miss s CROSS JOIN rg r LEFT JOIN cnt c ON c.chrom = s.chrom AND c.pos = s.pos AND c.material = 'Wild' AND c.region = r.region GROUP BY s.chrom, s.pos, r.region)",
    "occ AS (SELECT miss.chrom, miss.pos, minor, mc, maf, bin, CAST(count(*) FILTER (n > 0) AS INTEGER) AS nr, coalesce(string_agg(region, ';' ORDER BY region) FILTER (n > 0), 'None') AS rs, "
    + ", ".join(f"CAST(sum(n) FILTER (region = '{r}') AS BIGINT) AS n_{i}" for i, r in enumerate(REGIONS))
    + " FROM miss JOIN reg ON miss.chrom = reg.chrom AND miss.pos = reg.pos GROUP BY miss.chrom, miss.pos, minor, mc, maf, bin)",
    "occt AS (SELECT * FROM occ JOIN th ON mc >= tmin)",
    "cnts AS (SELECT CAST(r AS INTEGER) AS nr FROM range(0, 4) AS t(r))",
]

_N = {g: f"(SELECT count(*) FROM samples WHERE garden = '{g}')" for g in GARDENS}
# Hypergeometric chance of at least one of c copies in a draw of d of a.
_RARE = [
    f"ns AS (SELECT {_N['Pingshun']} AS nps, {_N['Tongguan']} AS ntg, {_N['Zhendong']} AS nzd)",
    "dr AS (SELECT uni.*, nps, ntg, nzd, least(Pingshun_AN, CAST(round_even(CAST(Pingshun_AN AS DOUBLE) * ntg / nps, 0) AS BIGINT)) AS dt, least(Pingshun_AN, CAST(round_even(CAST(Pingshun_AN AS DOUBLE) * nzd / nps, 0) AS BIGINT)) AS dz FROM uni, ns)",
    "pr AS (SELECT *, "
    + ", ".join(
        f"CASE WHEN Pingshun_AN <= 0 OR n_Pingshun <= 0 OR {d} <= 0 THEN 0.0 WHEN {d} > Pingshun_AN - n_Pingshun THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - exp(lgamma(Pingshun_AN - n_Pingshun + 1) - lgamma(Pingshun_AN - n_Pingshun - {d} + 1) - lgamma(Pingshun_AN + 1) + lgamma(Pingshun_AN - {d} + 1)))) END AS p{d}"
        for d in ("dt", "dz")
    )
    + " FROM dr)",
    "sets AS (SELECT 'PS_RG_observed' AS s, 'observed' AS k, nps AS nn, 1 AS o FROM ns UNION ALL SELECT 'TG_RG_observed', 'observed', ntg, 2 FROM ns UNION ALL SELECT 'ZD_RG_observed', 'observed', nzd, 3 FROM ns"
    " UNION ALL SELECT 'PS_RG_rarefied_to_TG_RG_sample_size_n' || ntg || '_expected', 'allele_copy_rarefied_expected', ntg, 4 FROM ns UNION ALL SELECT 'PS_RG_rarefied_to_ZD_RG_sample_size_n' || nzd || '_expected', 'allele_copy_rarefied_expected', nzd, 5 FROM ns)",
    "val AS (SELECT bin, mc, s, k, nn, CASE o WHEN 1 THEN CAST(n_Pingshun > 0 AS INTEGER) WHEN 2 THEN CAST(n_Tongguan > 0 AS INTEGER) WHEN 3 THEN CAST(n_Zhendong > 0 AS INTEGER) WHEN 4 THEN pdt ELSE pdz END AS v FROM pr, sets)",
]
_RARE_COLS = f"count(v.mc) AS Total_Wild_SNP_minor_alleles, {rnd('coalesce(sum(v.v), 0)')} AS Retained_Wild_SNP_minor_alleles, {share('coalesce(sum(v.v), 0)', 'count(v.mc)')} AS Retention_rate, {rnd('count(v.mc) - coalesce(sum(v.v), 0)')} AS Missing_or_not_retained, {share('count(v.mc) - coalesce(sum(v.v), 0)', 'count(v.mc)')} AS Missing_rate"
_SET_COLS = "sets.s AS Target_set, sets.k AS Comparison_type, CAST(sets.nn AS INTEGER) AS Nominal_sample_size"

_CALL = [
    "nn AS (SELECT count(*) FILTER (material = 'Wild') AS nw, count(*) FILTER (material = 'Ex_situ') AS ne FROM samples)",
    "rt AS (SELECT uni.*, Wild_AN / (2.0 * nw) AS wr, Ex_situ_AN / (2.0 * ne) AS er, CASE WHEN n_Ex_situ = 0 THEN 'Ex_situ_missing' ELSE 'Ex_situ_retained' END AS st FROM uni, nn)",
    "rx AS (SELECT st, t, tmin, b.bin, wr, er FROM rt JOIN th ON mc >= tmin JOIN allbins b ON b.bin = rt.bin OR b.bin = 'All')",
    "grid AS (SELECT *, round_even(wr * 1000, 0) / 1000.0 AS wg, round_even(er * 1000, 0) / 1000.0 AS eg FROM rx)",
    "gq AS (SELECT *, row_number() OVER (PARTITION BY st, t, bin ORDER BY wg) AS iw, row_number() OVER (PARTITION BY st, t, bin ORDER BY eg) AS ie, count(*) OVER (PARTITION BY st, t, bin) AS n FROM grid)",
]


def _call_cols() -> str:
    out = []
    for g, r, x, i in (("Wild", "wr", "wg", "iw"), ("Ex_situ", "er", "eg", "ie")):
        p = f"{g}_call_rate"
        out += [f"{rnd(f'avg({r})')} AS {p}_mean", f"{rnd(f'min({r})')} AS {p}_min", f"{rnd(f'max({r})')} AS {p}_max"]
        out += [f"{rnd(f'max({x}) FILTER ({i} = CAST(ceil({v} * (n - 1)) AS BIGINT) + 1)')} AS {p}_{k}" for k, v in (("p01_approx", 0.01), ("p05_approx", 0.05), ("median_approx", 0.5), ("p95_approx", 0.95))]
        for lv in ("0_50", "0_80", "0_90", "0_95"):
            c = f"count({r}) FILTER ({r} < {lv.replace('_', '.')})"
            out += [f"{c} AS {p}_lt_{lv}_N", f"{share(c, f'count({r})')} AS {p}_lt_{lv}_fraction"]
    return ", ".join(out)


_CARR = [
    "cr AS (SELECT c.chrom, c.pos, c.sample_id, c.dp, c.gq, miss.mc, miss.bin, CAST(c.a1 = CAST(minor = 'ALT' AS INTEGER) AS INTEGER) + CAST(c.a2 = CAST(minor = 'ALT' AS INTEGER) AS INTEGER) AS dos FROM cnt c JOIN miss ON c.chrom = miss.chrom AND c.pos = miss.pos WHERE c.a2 IS NOT NULL)",
    "crx AS (SELECT t, b.bin, dos, dp, gq FROM cr JOIN th ON mc >= tmin JOIN allbins b ON b.bin = cr.bin OR b.bin = 'All' WHERE dos > 0)",
]


def _val_cols() -> str:
    out = []
    for p, c in (("DP", "dp"), ("GQ", "gq")):
        out += [f"count(x.{c}) AS {p}_N", f"{rnd(f'avg(x.{c})')} AS {p}_Mean", f"min(x.{c}) AS {p}_Min", f"max(x.{c}) AS {p}_Max"]
        out += [f"{rnd(f'quantile_cont(x.{c}, {v})')} AS {p}_{k}" for k, v in (("P05", 0.05), ("P25", 0.25), ("Median", 0.5), ("P75", 0.75), ("P95", 0.95))]
    return ", ".join(out)


_LEVELS = [0.9, 0.8, 0.7, 0.5]
_EDGES = [
    "pr0 AS (SELECT least(o_custkey % 100, (o_orderkey // 7) % 100) AS i, greatest(o_custkey % 100, (o_orderkey // 7) % 100) AS j, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) % 1000 / CAST(1000 AS DOUBLE) AS s FROM orders GROUP BY 1, 2)",
    "pr2 AS (SELECT i, j, s * s AS s2 FROM pr0 WHERE i <> j), pr4 AS (SELECT i, j, s2 * s2 AS s4 FROM pr2), pr8 AS (SELECT i, j, s4 * s4 AS s8 FROM pr4), pr24 AS (SELECT i, j, (s8 * s8) * s8 AS s FROM pr8)",
    "pairs AS (SELECT least(x.sample_id, y.sample_id) AS a, greatest(x.sample_id, y.sample_id) AS b, s AS pi FROM pr24 JOIN samples x ON x.ord = i JOIN samples y ON y.ord = j)",
    values("lv", "th, label", [(t, f"PIHAT_ge_{t:.2f}") for t in _LEVELS]),
    "mem AS (SELECT 'All' AS scope, sample_id FROM samples UNION ALL SELECT material, sample_id FROM samples UNION ALL SELECT garden, sample_id FROM samples WHERE garden <> 'NA')",
    "nodes AS (SELECT 'global' AS scope, th, sample_id FROM samples, lv UNION ALL SELECT scope, th, sample_id FROM mem, lv)",
    "half AS (SELECT 'global' AS scope, th, a, b FROM pairs JOIN lv ON pi >= th UNION ALL SELECT x.scope, th, a, b FROM pairs JOIN lv ON pi >= th JOIN mem x ON x.sample_id = a JOIN mem y ON y.sample_id = b AND x.scope = y.scope)",
    "both_ AS (SELECT scope, th, a, b FROM half UNION ALL SELECT scope, th, b, a FROM half)",
    "reach AS (SELECT scope, th, sample_id AS n, sample_id AS r FROM nodes UNION SELECT reach.scope, reach.th, n, b FROM reach JOIN both_ ON both_.scope = reach.scope AND both_.th = reach.th AND both_.a = reach.r)",
    "comp0 AS (SELECT scope, th, n AS sample_id, min(r) AS rep FROM reach GROUP BY scope, th, n)",
    "comp AS (SELECT *, count(*) OVER (PARTITION BY scope, th, rep) AS size, dense_rank() OVER (PARTITION BY scope, th ORDER BY rep) AS no FROM comp0)",
]
_CORE = [*_EDGES, "coll AS (SELECT c.*, s.garden, s.material, s.region, c.sample_id = c.rep AS keep FROM comp c JOIN samples s USING (sample_id) WHERE scope = 'Ex_situ' AND th = 0.8)"]
_ALTS = [
    *_CORE,
    "mc0 AS (SELECT c.chrom, c.pos, c.p, c.sample_id, CASE WHEN p % 7 = 0 THEN 'G,T' WHEN p % 11 = 0 THEN 'C,*' WHEN p % 13 = 0 THEN 'g' WHEN p % 17 = 0 THEN 'A' ELSE 'C' END AS alt, CASE WHEN p % 13 = 0 AND p % 7 <> 0 AND p % 11 <> 0 THEN 'a' ELSE 'A' END AS ref, unnest([a1, a2]) AS a0, ord FROM calls c WHERE material = 'Ex_situ')",
    "mcx AS (SELECT *, CASE WHEN (p % 7 = 0 OR p % 11 = 0) AND ord % 2 = 0 AND a0 = 1 THEN 2 ELSE a0 END AS code FROM mc0 WHERE a0 IS NOT NULL)",
    "mk AS (SELECT mcx.*, keep, garden FROM mcx JOIN coll USING (sample_id))",
    "tot AS (SELECT chrom, pos, ref, alt, count(*) AS an, count(*) FILTER (keep) AS can FROM mk GROUP BY ALL)",
    "st0 AS (SELECT chrom, pos, ref, alt, code, count(*) AS ac, count(*) FILTER (keep) AS cac, string_agg(DISTINCT garden, ';' ORDER BY garden) FILTER (NOT keep) AS src FROM mk WHERE code > 0 GROUP BY ALL)",
    "st1 AS (SELECT st0.*, an, can, split_part(st0.alt, ',', code) AS one FROM st0 JOIN tot USING (chrom, pos, ref, alt))",
    f"st AS (SELECT *, CASE WHEN ac = 1 THEN '{ALT[0]}' WHEN ac <= 5 THEN '{ALT[1]}' WHEN ac / an <= 0.01 THEN '{ALT[2]}' WHEN ac / an <= 0.05 THEN '{ALT[3]}' WHEN ac / an <= 0.10 THEN '{ALT[4]}' ELSE '{ALT[5]}' END AS fb FROM st1 WHERE upper(ref) IN ('A','C','G','T') AND upper(one) IN ('A','C','G','T') AND upper(ref) <> upper(one))",
    values("ab", "fb", ["All", *ALT]),
]

_WEIGHT = f"CAST(CASE bin WHEN '{BINS[0]}' THEN 1.0 WHEN '{BINS[1]}' THEN 2.0 WHEN '{BINS[2]}' THEN 2.0 ELSE 0.0 END AS DOUBLE)"


def _greedy() -> list[str]:
    out = [
        "dip AS (SELECT c.chrom, c.pos, c.sample_id, miss.bin, miss.mc, CAST(minor = 'ALT' AS INTEGER) IN (c.a1, c.a2) AS carries FROM cnt c JOIN miss ON c.chrom = miss.chrom AND c.pos = miss.pos WHERE c.material = 'Wild' AND c.a2 IS NOT NULL)",
        "tn AS (SELECT count(*) AS t FROM miss)",
        "rate AS (SELECT s.sample_id, s.region, s.ord, count(d.pos) AS called, any_value(t) AS t, CASE WHEN any_value(t) = 0 THEN 0.0 ELSE count(d.pos) / any_value(t) END AS r FROM samples s CROSS JOIN tn LEFT JOIN dip d ON d.sample_id = s.sample_id WHERE s.material = 'Wild' GROUP BY s.sample_id, s.region, s.ord)",
        f"car AS (SELECT chrom, pos, sample_id, bin, {_WEIGHT} AS w FROM dip WHERE carries)",
        "p0 AS (SELECT CAST(0 AS INTEGER) AS step, '' AS plan, '' AS sample_id, '' AS region, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS total, CAST(0 AS DOUBLE) AS r, 0 AS ord WHERE false)",
    ]
    n = 0
    for plan, qs in PLANS.items():
        for _ in range(sum(qs) - (n if n else 0)):
            n += 1
            out.append(
                f"c{n} AS (SELECT DISTINCT chrom, pos FROM car WHERE sample_id IN (SELECT sample_id FROM p{n - 1})), "
                f"s{n} AS (SELECT {n} AS step, '{plan}' AS plan, rate.sample_id, rate.region, coalesce(sum(g.w), 0.0) AS score, count(g.pos) AS total, any_value(rate.r) AS r, any_value(rate.ord) AS ord FROM rate JOIN quota ON quota.plan = '{plan}' AND quota.region = rate.region "
                f"LEFT JOIN (SELECT * FROM car ANTI JOIN c{n} USING (chrom, pos)) g ON g.sample_id = rate.sample_id WHERE rate.sample_id NOT IN (SELECT sample_id FROM p{n - 1}) AND (SELECT count(*) FROM p{n - 1} x WHERE x.region = rate.region) < quota.q "
                f"GROUP BY rate.sample_id, rate.region ORDER BY score DESC, total DESC, r DESC, ord LIMIT 1), p{n} AS (SELECT * FROM p{n - 1} UNION ALL SELECT * FROM s{n})"
            )
    a = sum(PLANS["Greedy_Plan_A"])
    out.append(f"sel AS (SELECT 'Greedy_Plan_A' AS plan, row_number() OVER (ORDER BY step) AS step, sample_id, region, score, total, r, ord FROM p{a} UNION ALL SELECT 'Greedy_Plan_B', row_number() OVER (ORDER BY step), sample_id, region, score, total, r, ord FROM p{n})")
    return out


_G = _greedy()
_SEL = "plan AS Plan, CAST(step AS INTEGER) AS Plan_step, sample_id AS SampleID, region AS Region, score AS Marginal_weighted_score, total AS Marginal_new_All, " + rnd("r") + " AS Target_site_call_rate"
_REC = [
    *_G,
    "goal AS (SELECT miss.chrom, miss.pos, t, tmin, b.bin FROM miss JOIN th ON mc >= tmin JOIN allbins b ON b.bin = miss.bin OR b.bin = 'All')",
    "cov AS (SELECT DISTINCT plan, chrom, pos FROM sel JOIN car ON car.sample_id = sel.sample_id)",
    "pls AS (SELECT plan, count(*) AS n FROM sel GROUP BY plan)",
]
_ROH = "roh AS (SELECT s.sample_id, count(*) FILTER (value * 10 > CASE WHEN s.ord % 7 = 3 THEN 4600 ELSE 4200 END) > 0 AS lng FROM samples s LEFT JOIN events e ON e.user_id % 100 = s.ord GROUP BY s.sample_id)"
_QC = [
    *_EDGES,
    *_G,
    _ROH,
    "pct AS (SELECT sample_id, cume_dist() OVER (ORDER BY r) AS pct FROM rate)",
    "qc AS (SELECT sel.plan, sel.step, sel.sample_id, sel.r, pct, 'PIHAT_ge_0.80_C' || lpad(CAST(no AS VARCHAR), 4, '0') AS cid, size, lng FROM sel JOIN pct USING (sample_id) JOIN comp ON comp.sample_id = sel.sample_id AND comp.scope = 'global' AND comp.th = 0.8 JOIN roh ON roh.sample_id = sel.sample_id)",
    "rep_ AS (SELECT plan, cid, count(*) AS n, string_agg(sample_id, ';' ORDER BY step) AS ids FROM qc GROUP BY plan, cid HAVING count(*) > 1)",
]
_PORT = [
    *_CORE,
    *_G,
    "port AS (SELECT 'Current' AS pf, sample_id FROM coll UNION ALL SELECT 'Core', sample_id FROM coll WHERE keep UNION ALL SELECT 'Plan_A', sample_id FROM coll WHERE keep UNION ALL SELECT 'Plan_B', sample_id FROM coll WHERE keep UNION ALL SELECT CASE plan WHEN 'Greedy_Plan_A' THEN 'Plan_A' ELSE 'Plan_B' END, sample_id FROM sel)",
    "pres AS (SELECT u.chrom, u.pos, "
    + ", ".join(f"coalesce(bool_or(port.pf = '{p}' AND CAST(minor = 'ALT' AS INTEGER) IN (c.a1, coalesce(c.a2, c.a1))), false) AS {p}" for p in ("Current", "Core", "Plan_A", "Plan_B"))
    + " FROM uni u JOIN cnt c ON c.chrom = u.chrom AND c.pos = u.pos LEFT JOIN port ON port.sample_id = c.sample_id GROUP BY u.chrom, u.pos)",
    "cn AS (SELECT count(*) AS target_total, count(*) FILTER (NOT Current) AS Current_missing, count(*) FILTER (NOT Core) AS Core_missing, count(*) FILTER (NOT Plan_A) AS Plan_A_missing, count(*) FILTER (NOT Plan_B) AS Plan_B_missing, count(*) FILTER (Current AND NOT Core) AS core_added_loss,"
    " count(*) FILTER (Current AND NOT Core AND Plan_A) AS Plan_A_rescued_loss, count(*) FILTER (NOT Current AND Plan_A) AS Plan_A_recovered_original, count(*) FILTER (Current AND NOT Core AND Plan_B) AS Plan_B_rescued_loss, count(*) FILTER (NOT Current AND Plan_B) AS Plan_B_recovered_original FROM pres)",
]
HASHED_N = 1000
_HASH = [
    *_REC,
    f"pool AS (SELECT plan, k.perm, s.region, s.sample_id, q, row_number() OVER (PARTITION BY plan, k.perm, s.region ORDER BY md5('7|' || plan || '|' || k.perm || '|' || s.sample_id), s.sample_id) AS rk FROM samples s JOIN quota ON quota.region = s.region, range(1, {HASHED_N + 1}) AS k(perm) WHERE s.material = 'Wild' AND q > 0)",
    "draw AS (SELECT * FROM pool WHERE rk <= q)",
    "tb AS (SELECT b.bin, count(miss.pos) AS t FROM allbins b LEFT JOIN miss ON miss.bin = b.bin OR b.bin = 'All' GROUP BY b.bin)",
    "hit AS (SELECT DISTINCT plan, perm, car.chrom, car.pos, car.bin FROM draw JOIN car USING (sample_id))",
    "dist AS (SELECT d.plan, d.perm, d.n, tb.bin, count(h.pos) AS r, tb.t, CASE WHEN tb.t = 0 THEN 0.0 ELSE count(h.pos) / tb.t END AS x FROM (SELECT plan, perm, count(*) AS n FROM draw GROUP BY plan, perm) d CROSS JOIN tb LEFT JOIN hit h ON h.plan = d.plan AND h.perm = d.perm AND (h.bin = tb.bin OR tb.bin = 'All') GROUP BY d.plan, d.perm, d.n, tb.bin, tb.t)",
    "obs AS (SELECT p.plan, tb.bin, count(c.pos) AS r, CASE WHEN tb.t = 0 THEN 0.0 ELSE count(c.pos) / tb.t END AS x FROM pls p CROSS JOIN tb LEFT JOIN (SELECT cov.plan, miss.chrom, miss.pos, miss.bin FROM cov JOIN miss USING (chrom, pos)) c ON c.plan = p.plan AND (c.bin = tb.bin OR tb.bin = 'All') GROUP BY p.plan, tb.bin, tb.t)",
]
_GT = [
    "g0 AS (SELECT p, a1 || '/' || coalesce(CAST(a2 AS VARCHAR), '.') AS gt FROM calls)",
    "g AS (SELECT CASE p % 7 WHEN 1 THEN replace(gt, '/', '|') WHEN 2 THEN gt || '/0' WHEN 3 THEN gt[1:1] WHEN 4 THEN replace(gt, '0/', 'x/') WHEN 5 THEN replace(gt, '0/', './') ELSE gt END AS gt, count(*) AS n FROM g0 GROUP BY ALL)",
]

SQL = {
    "retention_overall": q(f"SELECT g AS Target_group, {_RET} FROM (SELECT gr.g, count(h.n) AS n, count(*) FILTER (h.n > 0) AS k FROM gr LEFT JOIN held h USING (g) GROUP BY gr.g)"),
    "retention_by_maf": q(f"SELECT g AS Target_group, bin AS Wild_MAF_bin, {_RET} FROM (SELECT gr.g, bins.bin, count(h.n) AS n, count(*) FILTER (h.n > 0) AS k FROM gr CROSS JOIN bins LEFT JOIN held h ON h.g = gr.g AND h.bin = bins.bin GROUP BY gr.g, bins.bin)"),
    "retention_by_threshold": q(f"SELECT t AS AC_threshold, tmin AS Wild_minor_count_min, {_THR} FROM (SELECT t, tmin, count(u.pos) AS n, count(*) FILTER (u.n_Ex_situ = 0) AS x FROM th LEFT JOIN uni u ON u.mc >= tmin GROUP BY t, tmin)"),
    "retention_threshold_by_maf": q(f"SELECT t AS AC_threshold, tmin AS Wild_minor_count_min, bin AS Wild_MAF_bin, {_THR} FROM (SELECT t, tmin, bins.bin, count(u.pos) AS n, count(*) FILTER (u.n_Ex_situ = 0) AS x FROM th CROSS JOIN bins LEFT JOIN uni u ON u.mc >= tmin AND u.bin = bins.bin GROUP BY t, tmin, bins.bin)"),
    "missing_targets": q(f"SELECT chrom AS CHROM, pos AS POS, Wild_AC, Wild_AN, Wild_AN - Wild_AC AS Wild_REF_count, Wild_AC AS Wild_ALT_count, minor AS Wild_minor_allele, mc AS Wild_minor_count, {rnd('maf')} AS Wild_minor_MAF, bin AS Wild_MAF_bin, Ex_situ_AC, Ex_situ_AN, Ex_situ_AN - Ex_situ_AC AS Ex_situ_REF_count, Ex_situ_AC AS Ex_situ_ALT_count FROM miss"),
    "complementarity_by_site": q(f"SELECT chrom AS CHROM, pos AS POS, minor AS Wild_minor_allele, mc AS Wild_minor_count, {rnd('maf')} AS Wild_minor_MAF, bin AS Wild_MAF_bin, n_Pingshun AS Pingshun_minor_count, n_Tongguan AS Tongguan_minor_count, n_Zhendong AS Zhendong_minor_count, cls AS Complementarity_class FROM ps", _BY_SITE),
    "complementarity_summary": q(
        f"SELECT bin AS Wild_MAF_bin, n AS PS_RG_missing_Wild_minor_alleles, c1 AS TG_RG_only, c2 AS ZD_RG_only, c3 AS Both_TG_RG_and_ZD_RG, c4 AS Still_missing_from_all_ex_situ, n - c4 AS Recovered_by_TG_RG_or_ZD_RG, {share('n - c4', 'n')} AS Recovery_rate_by_Tongguan_or_Zhendong, {share('c4', 'n')} AS Still_missing_rate_in_all_exsitu FROM "
        "(SELECT b.bin, count(ps.pos) AS n, count(*) FILTER (cls = 'TG_RG_only') AS c1, count(*) FILTER (cls = 'ZD_RG_only') AS c2, count(*) FILTER (cls = 'Both_TG_RG_and_ZD_RG') AS c3, count(*) FILTER (cls = 'Still_missing_from_all_ex_situ') AS c4 FROM allbins b LEFT JOIN ps ON ps.bin = b.bin OR b.bin = 'All' GROUP BY b.bin)", _BY_SITE),  # fmt: skip
    "regional_by_site": q(f"SELECT chrom AS CHROM, pos AS POS, minor AS Wild_minor_allele, mc AS Wild_minor_count, {rnd('maf')} AS Wild_minor_MAF, bin AS Wild_MAF_bin, nr AS Presence_region_count, rs AS Presence_regions, CASE WHEN nr = 1 THEN rs ELSE 'NA' END AS Region_specific_region, n_0 AS AFRICA_minor_count, n_1 AS AMERICA_minor_count, n_2 AS MIDDLE_EAST_minor_count FROM occ", *_OCC),
    "regional_presence": q("SELECT th.t AS AC_threshold, th.tmin AS Wild_minor_count_min, cnts.nr AS Presence_region_count, count(o.pos) AS N_missing_Wild_minor_alleles FROM th CROSS JOIN cnts LEFT JOIN occt o ON o.t = th.t AND o.nr = cnts.nr GROUP BY th.t, th.tmin, cnts.nr", *_OCC),
    "regional_presence_by_maf": q("SELECT th.t AS AC_threshold, th.tmin AS Wild_minor_count_min, bins.bin AS Wild_MAF_bin, cnts.nr AS Presence_region_count, count(o.pos) AS N_missing_Wild_minor_alleles FROM th CROSS JOIN cnts CROSS JOIN bins LEFT JOIN occt o ON o.t = th.t AND o.nr = cnts.nr AND o.bin = bins.bin GROUP BY th.t, th.tmin, bins.bin, cnts.nr", *_OCC),
    "regional_gap": q(f"SELECT th.t AS AC_threshold, th.tmin AS Wild_minor_count_min, r.region AS Region, r.n AS Wild_sample_N, count(o.pos) AS Region_specific_missing_Wild_minor_alleles, {rnd('count(o.pos) / r.n')} AS Region_specific_gap_per_sample FROM th CROSS JOIN rsize r LEFT JOIN occt o ON o.t = th.t AND o.nr = 1 AND o.rs = r.region GROUP BY th.t, th.tmin, r.region, r.n", *_OCC),
    "rarefied_overall": q(f"SELECT {_SET_COLS}, {_RARE_COLS} FROM sets LEFT JOIN val v USING (s) GROUP BY sets.s, sets.k, sets.nn", *_RARE),
    "rarefied_by_maf": q(f"SELECT {_SET_COLS}, bins.bin AS Wild_MAF_bin, {_RARE_COLS} FROM sets CROSS JOIN bins LEFT JOIN val v ON v.s = sets.s AND v.bin = bins.bin GROUP BY sets.s, sets.k, sets.nn, bins.bin", *_RARE),
    "rarefied_by_threshold": q(f"SELECT th.t AS AC_threshold, th.tmin AS Wild_minor_count_min, {_SET_COLS}, {_RARE_COLS} FROM sets CROSS JOIN th LEFT JOIN val v ON v.s = sets.s AND v.mc >= tmin GROUP BY th.t, th.tmin, sets.s, sets.k, sets.nn", *_RARE),
    "callability_sites": q(f"SELECT chrom AS CHROM, pos AS POS, minor AS Wild_minor_allele, mc AS Wild_minor_count, {rnd('maf')} AS Wild_minor_MAF, bin AS Wild_MAF_bin, Wild_AN, Ex_situ_AN, {rnd('wr')} AS Wild_call_rate, {rnd('er')} AS Ex_situ_call_rate, st AS Allele_status FROM rt WHERE st = 'Ex_situ_missing'", *_CALL),
    "callability_summary": q(f"SELECT s.st AS Allele_status, th.t AS AC_threshold, th.tmin AS Wild_minor_count_min, b.bin AS Wild_MAF_bin, count(wr) AS Site_N, {_call_cols()} FROM (VALUES ('Ex_situ_missing'), ('Ex_situ_retained')) AS s(st) CROSS JOIN th CROSS JOIN allbins b LEFT JOIN gq ON gq.st = s.st AND gq.t = th.t AND gq.bin = b.bin GROUP BY s.st, th.t, th.tmin, b.bin", *_CALL),
    "status_disagreements": q("SELECT chrom, pos, n_Ex_situ <= 0 AS rebuilt, CASE WHEN n_Ex_situ > 0 THEN true END AS listed FROM uni WHERE (n_Ex_situ > 0 AND CAST(pos AS BIGINT) % 40 = 7) OR (n_Ex_situ <= 0 AND CAST(pos AS BIGINT) % 5 = 3)"),
    "carrier_quality": q(f"SELECT th.t AS AC_threshold, th.tmin AS Wild_minor_count_min, b.bin AS Wild_MAF_bin, count(x.dos) AS Carrier_genotype_N, CAST(coalesce(sum(x.dos), 0) AS BIGINT) AS Carrier_target_allele_copies, {_val_cols()} FROM th CROSS JOIN allbins b LEFT JOIN crx x ON x.t = th.t AND x.bin = b.bin GROUP BY th.t, th.tmin, b.bin", *_CARR),
    "similarity_pairs": q(f"SELECT a, b, {rnd('pi')} AS pi_hat FROM pairs", *_EDGES),
    "global_threshold_summary": q(f"SELECT label AS Threshold, c.th AS PI_HAT_min, count(*) AS Total_samples, (SELECT count(*) FROM pairs WHERE pi >= c.th) AS High_similarity_pair_count, count(*) FILTER (sample_id = rep) AS Effective_independent_N, count(*) FILTER (sample_id = rep AND size >= 2) AS Redundant_component_N, count(*) FILTER (size >= 2) AS Samples_in_redundant_components, count(*) FILTER (sample_id <> rep) AS Redundant_nonrepresentative_N, {rnd('count(*) FILTER (sample_id <> rep) / count(*)')} AS Redundancy_rate FROM comp c JOIN lv ON lv.th = c.th WHERE scope = 'global' GROUP BY label, c.th", *_EDGES),
    "group_threshold_summary": q(f"SELECT label AS Threshold, x.th AS PI_HAT_min, gs AS Graph_scope, grp AS \"Group\", nn AS Nominal_N, e AS Effective_independent_N, nn - e AS Redundant_reduction_N, {share0('nn - e', 'nn')} AS Redundancy_rate FROM (SELECT 'global_component_membership' AS gs, mem.scope AS grp, th, count(*) AS nn, count(DISTINCT rep) AS e FROM mem JOIN comp ON comp.sample_id = mem.sample_id AND comp.scope = 'global' GROUP BY mem.scope, th UNION ALL SELECT 'induced_subgraph', scope, th, count(*), count(DISTINCT rep) FROM comp WHERE scope <> 'global' GROUP BY scope, th) x JOIN lv ON lv.th = x.th", *_EDGES),
    "component_summary": q("SELECT label AS Threshold, c.th AS PI_HAT_min, label || '_C' || lpad(CAST(no AS VARCHAR), 4, '0') AS Component_ID, count(*) AS Component_size, rep AS Representative_sample_global, count(*) FILTER (material = 'Wild') AS N_Wild, count(*) FILTER (material = 'Ex_situ') AS N_Ex_situ, count(*) FILTER (garden = 'Pingshun') AS N_Pingshun, count(*) FILTER (garden = 'Tongguan') AS N_Tongguan, count(*) FILTER (garden = 'Zhendong') AS N_Zhendong, string_agg(c.sample_id, ';' ORDER BY c.sample_id) AS Samples FROM comp c JOIN lv ON lv.th = c.th JOIN samples s ON s.sample_id = c.sample_id WHERE scope = 'global' GROUP BY label, c.th, no, rep", *_EDGES),
    "components_status": q("SELECT label AS Threshold, c.th AS PI_HAT_min, c.sample_id AS SampleID, label || '_C' || lpad(CAST(no AS VARCHAR), 4, '0') AS Global_component_ID, size AS Global_component_size, rep AS Global_representative_sample, c.sample_id = rep AS Is_global_representative, material AS Material_type, garden AS Ex_situ_site, region AS Region FROM comp c JOIN lv ON lv.th = c.th JOIN samples s ON s.sample_id = c.sample_id WHERE scope = 'global'", *_EDGES),
    "dedup_core": q("SELECT sample_id AS SampleID, size AS Ex_situ_component_size, rep AS Representative_sample, 'Core_keep' AS Management_class, garden AS Ex_situ_site FROM coll WHERE keep", *_CORE),
    "dedup_low": q("SELECT sample_id AS SampleID, size AS Ex_situ_component_size, rep AS Representative_sample, 'Lower_priority_redundant' AS Management_class, garden AS Ex_situ_site FROM coll WHERE NOT keep", *_CORE),
    "alt_state_summary": q(f"SELECT ab.fb AS Current_ALT_freq_bin, count(st.ac) AS Current_ex_situ_observed_ALT_states, count(*) FILTER (cac > 0) AS ALT_states_retained_in_core, count(*) FILTER (cac = 0) AS ALT_states_lost_after_deredundancy, {share0('count(*) FILTER (cac > 0)', 'count(st.ac)')} AS ALT_state_presence_retention_rate, CAST(coalesce(sum(ac), 0) AS BIGINT) AS Current_ex_situ_ALT_copies, CAST(coalesce(sum(ac) FILTER (cac > 0), 0) AS BIGINT) AS Current_ALT_copies_covered_by_core_presence, CAST(coalesce(sum(ac) FILTER (cac = 0), 0) AS BIGINT) AS Current_ALT_copies_not_covered_by_core_presence, {share0('coalesce(sum(ac) FILTER (cac > 0), 0)', 'coalesce(sum(ac), 0)')} AS True_ALT_copy_weighted_coverage_rate, CAST(coalesce(sum(cac), 0) AS BIGINT) AS Core_ALT_copy_sum_auxiliary FROM ab LEFT JOIN st ON st.fb = ab.fb OR ab.fb = 'All' GROUP BY ab.fb", *_ALTS),
    "alt_lost_states": q(f"SELECT chrom AS CHROM, pos AS POS, ref AS REF, code AS ALT_index, one AS ALT, an AS Current_AN, ac AS Current_ALT_AC, {rnd('ac / an')} AS Current_ALT_AF, can AS Core_AN, cac AS Core_ALT_AC, fb AS Current_ALT_freq_bin, ac AS Lost_current_ALT_copy_weight, src AS Loss_source_gardens FROM st WHERE cac = 0", *_ALTS),
    "alt_lost_sources": q("SELECT s.src AS Loss_source_gardens, ab.fb AS Current_ALT_freq_bin, count(st.ac) AS Lost_ALT_states, CAST(coalesce(sum(st.ac), 0) AS BIGINT) AS Lost_current_ALT_copies FROM (SELECT DISTINCT src FROM st WHERE cac = 0) s CROSS JOIN ab LEFT JOIN st ON st.cac = 0 AND st.src = s.src AND (st.fb = ab.fb OR ab.fb = 'All') GROUP BY s.src, ab.fb", *_ALTS),
    "call_rate": q(f"SELECT sample_id AS SampleID, region AS Region, called AS Called_target_sites, t AS Total_target_sites, {rnd('r')} AS Target_site_call_rate FROM rate", *_G),
    "greedy_plan_a": q(f"SELECT {_SEL} FROM sel WHERE plan = 'Greedy_Plan_A'", *_G),
    "greedy_plan_b": q(f"SELECT {_SEL} FROM sel WHERE plan = 'Greedy_Plan_B'", *_G),
    "greedy_recovery": q(f"SELECT p.plan AS Plan, p.n AS Wild_supplement_N, th.t AS AC_threshold, th.tmin AS Wild_minor_count_min, b.bin AS Wild_MAF_bin, count(g.pos) AS Missing_Wild_minor_alleles_total, count(c.pos) AS Recovered_missing_Wild_minor_alleles, {share0('count(c.pos)', 'count(g.pos)')} AS Recovery_rate FROM pls p CROSS JOIN th CROSS JOIN allbins b LEFT JOIN goal g ON g.t = th.t AND g.bin = b.bin LEFT JOIN cov c ON c.plan = p.plan AND c.chrom = g.chrom AND c.pos = g.pos GROUP BY p.plan, p.n, th.t, th.tmin, b.bin", *_REC),
    "greedy_cumulative": q(f"SELECT s.plan AS Plan, CAST(s.step AS INTEGER) AS Step, s.sample_id AS Selected_sample, b.bin AS Wild_MAF_bin, count(f.pos) AS Recovered_missing_Wild_minor_alleles, tb.t AS Missing_Wild_minor_alleles_total, {share0('count(f.pos)', 'tb.t')} AS Recovery_rate FROM sel s CROSS JOIN allbins b JOIN (SELECT b2.bin, count(miss.pos) AS t FROM allbins b2 LEFT JOIN miss ON miss.bin = b2.bin OR b2.bin = 'All' GROUP BY b2.bin) tb ON tb.bin = b.bin LEFT JOIN (SELECT sel.plan, car.chrom, car.pos, car.bin, min(step) AS step FROM sel JOIN car USING (sample_id) GROUP BY sel.plan, car.chrom, car.pos, car.bin) f ON f.plan = s.plan AND f.step <= s.step AND (f.bin = b.bin OR b.bin = 'All') GROUP BY s.plan, s.step, s.sample_id, b.bin, tb.t", *_REC),
    "region_composition": q("SELECT quota.plan AS Plan, quota.region AS Region, count(s.sample_id) AS Selected_sample_N, quota.q AS Quota, count(s.sample_id) = quota.q AS Quota_match FROM quota LEFT JOIN sel s ON s.plan = quota.plan AND s.region = quota.region GROUP BY quota.plan, quota.region, quota.q", *_G),
    "random_sampling_order": q("SELECT plan AS Plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY ro, region) AS INTEGER) AS Region_sampling_order, region AS Region, q AS Quota, n AS Available_Wild_samples, q > 0 AS Included_in_random_sampling FROM quota JOIN rsize USING (region)"),
    "random_control_hashed": q(f"SELECT plan AS Plan, 'random_region_matched' AS Control_type, CAST(perm AS INTEGER) AS Permutation, n AS Wild_supplement_N, bin AS Wild_MAF_bin, r AS Recovered_missing_Wild_minor_alleles, t AS Missing_Wild_minor_alleles_total, {rnd('x')} AS Recovery_rate FROM dist", *_HASH),
    "random_control_hashed_summary": q(
        f"SELECT d.plan AS Plan, 'random_region_matched' AS Control_type, d.n AS Wild_supplement_N, d.bin AS Wild_MAF_bin, d.t AS Missing_Wild_minor_alleles_total, o.r AS Greedy_recovered, {rnd('o.x')} AS Greedy_recovery_rate, count(*) AS Random_N, {rnd('avg(d.x)')} AS Random_mean, {rnd('coalesce(stddev_samp(d.x), 0)')} AS Random_sd, {rnd('min(d.x)')} AS Random_min, "
        + ", ".join(f"{rnd(f'quantile_cont(d.x, {v})')} AS Random_{k}" for k, v in (("q025", 0.025), ("q05", 0.05), ("q50", 0.5), ("q95", 0.95), ("q975", 0.975)))
        + f", {rnd('max(d.x)')} AS Random_max, {rnd('(o.x - quantile_cont(d.x, 0.975)) * 100')} AS Greedy_minus_random_q975_percentage_points, {rnd('(count(*) FILTER (d.x >= o.x) + 1) / (count(*) + 1)')} AS Empirical_p_random_ge_greedy, {rnd('count(*) FILTER (d.x <= o.x) / count(*)')} AS Greedy_percentile_vs_random, "
        f"{rnd('CASE WHEN coalesce(stddev_samp(d.x), 0) > 1e-12 THEN (o.x - avg(d.x)) / stddev_samp(d.x) ELSE 0 END')} AS Greedy_z_score FROM dist d JOIN obs o ON o.plan = d.plan AND o.bin = d.bin GROUP BY d.plan, d.n, d.bin, d.t, o.r, o.x", *_HASH),  # fmt: skip
    "qc_samples": q(f"SELECT plan AS Plan, CAST(step AS INTEGER) AS Step, sample_id AS SampleID, {rnd('r')} AS Target_site_call_rate, {rnd('pct')} AS Call_rate_percentile_within_all_Wild, r < 0.6 AS Below_selected_call_rate_threshold, cid AS Global_component_ID, size AS Global_component_size, lng AS ROH_gt_2Mb, 'NSEG_2_5Mb_plus_NSEG_gt5Mb' AS ROH_gt_2Mb_detection_method FROM qc", *_QC),
    "qc_by_plan": q(f"SELECT qc.plan AS Plan, count(*) AS Selected_sample_N, {rnd('min(r)')} AS Call_rate_min, {rnd('quantile_cont(r, 0.05)')} AS Call_rate_p05, {rnd('quantile_cont(r, 0.5)')} AS Call_rate_median, {rnd('avg(r)')} AS Call_rate_mean, {rnd('max(r)')} AS Call_rate_max, count(*) FILTER (r < 0.6) AS Below_call_rate_threshold_N, CAST(0.6 AS DOUBLE) AS Call_rate_threshold, count(*) FILTER (lng) AS Selected_with_ROH_gt_2Mb_N, (SELECT count(*) FROM rep_ WHERE rep_.plan = qc.plan) AS Repeated_PIHAT_component_N, CAST(coalesce((SELECT sum(n) FROM rep_ WHERE rep_.plan = qc.plan), 0) AS BIGINT) AS Repeated_selected_accession_N, 'NSEG_2_5Mb_plus_NSEG_gt5Mb' AS ROH_detection_method FROM qc GROUP BY qc.plan", *_QC),
    "qc_repeated_components": q("SELECT plan AS Plan, cid AS Global_component_ID, n AS Selected_sample_N, ids AS Selected_samples FROM rep_", *_QC),
    "portfolios": q("SELECT pf AS Portfolio, count(*) AS Sample_N, any_value(target_total) AS Target_total, any_value(target_total) - any_value(ms) AS Retained, any_value(ms) AS Missing, " + rnd("(any_value(target_total) - any_value(ms)) / any_value(target_total)") + " AS Retention_rate FROM (SELECT port.pf, target_total, CASE pf WHEN 'Current' THEN Current_missing WHEN 'Core' THEN Core_missing WHEN 'Plan_A' THEN Plan_A_missing ELSE Plan_B_missing END AS ms FROM port, cn) GROUP BY pf", *_PORT),
    "loss_and_rescue": q("SELECT * FROM cn", *_PORT),
    "portfolio_identities": q("SELECT 'core_loss' AS identity, Core_missing = Current_missing + core_added_loss AS holds FROM cn UNION ALL SELECT 'Plan_A_balance', Plan_A_missing = Current_missing - Plan_A_recovered_original + core_added_loss - Plan_A_rescued_loss FROM cn UNION ALL SELECT 'Plan_B_balance', Plan_B_missing = Current_missing - Plan_B_recovered_original + core_added_loss - Plan_B_rescued_loss FROM cn", *_PORT),
    "site_order_check": "WITH e AS (SELECT event_id AS row_index, event_type AS chrom, user_id AS pos_n, event_id FROM events), w AS (SELECT *, lag(pos_n) OVER (PARTITION BY chrom ORDER BY row_index) AS pp, lag(row_index) OVER (PARTITION BY chrom ORDER BY row_index) AS pr FROM e) SELECT chrom, pos_n, row_index, CASE WHEN pos_n <= pp THEN 'unsorted_or_duplicate' ELSE 'noncontiguous_chromosome' END AS violation FROM w WHERE pos_n <= pp OR row_index <> pr + 1",
    "duplicate_sites": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "anchor_checks": q("SELECT e.Item AS Item, o.v AS Observed, e.x AS Expected, abs(o.v - e.x) AS Absolute_difference, CASE WHEN o.v IS NULL THEN NULL WHEN e.x = floor(e.x) THEN 0.0 ELSE 1e-8 END AS Tolerance, CASE WHEN o.v IS NULL THEN 'NOT_IMPLEMENTED' WHEN abs(o.v - e.x) <= CASE WHEN e.x = floor(e.x) THEN 0.0 ELSE 1e-8 END THEN 'PASS' ELSE 'FAIL' END AS Status FROM (SELECT 'wild_minor_total' AS Item, CAST(171 AS DOUBLE) AS x UNION ALL SELECT 'combined_ex_situ_missing', 19 UNION ALL SELECT 'half', 0.5 UNION ALL SELECT 'unknown', 1) e LEFT JOIN (SELECT 'wild_minor_total' AS Item, CAST(count(*) AS DOUBLE) AS v FROM uni UNION ALL SELECT 'combined_ex_situ_missing', count(*) FROM miss UNION ALL SELECT 'half', 0.5) o USING (Item)"),
    "invariants": q(
        "SELECT 'retained_plus_missing' AS Invariant, CASE WHEN kept + lost = total THEN 'PASS' ELSE 'FAIL' END AS Status, 'kept=' || kept || ', lost=' || lost || ', total=' || total AS Detail FROM iv"
        " UNION ALL SELECT 'complement_still_missing', CASE WHEN still = lost THEN 'PASS' ELSE 'FAIL' END, 'still=' || still || ', lost=' || lost FROM iv"
        " UNION ALL SELECT 'regions_partition_missing', CASE WHEN regional = lost THEN 'PASS' ELSE 'FAIL' END, 'regional=' || regional || ', lost=' || lost FROM iv", _BY_SITE, *_OCC,
        "iv AS (SELECT count(*) FILTER (n_Ex_situ > 0) AS kept, count(*) FILTER (n_Ex_situ = 0) AS lost, count(*) AS total, (SELECT count(*) FROM ps WHERE cls = 'Still_missing_from_all_ex_situ') AS still, (SELECT count(*) FROM occ) AS regional FROM uni)"),
    "region_canonicalise": r"""WITH s AS (SELECT s_suppkey, ['qinling', 'Lvliang_Mountains', 'TAIHANG', '', 'Zhongtiaoshan', 'southern  loess', 'na'][s_suppkey % 7 + 1] AS stem, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        x AS (SELECT s_suppkey, trim(regexp_replace(replace(CASE s_suppkey % 3 WHEN 0 THEN '  ' || upper(stem) WHEN 1 THEN stem || chr(9) ELSE stem || ' ' || n_name END, '_', ' '), '\s+', ' ', 'g')) AS t FROM s)
        SELECT s_suppkey, CASE lower(t) WHEN '' THEN 'NA' WHEN 'qinling' THEN 'Qinling Mountains' WHEN 'lvliang mountains' THEN 'Lvliang Mountain' WHEN 'taihang' THEN 'Taihang Mountains' WHEN 'zhongtiaoshan' THEN 'Zhongtiao Mountain' WHEN 'southern loess' THEN 'Southern Loess Plateau' ELSE t END AS region FROM x""",
    "genotype_readings": q("SELECT gt, n, CASE WHEN regexp_full_match(gt, '[0-9][/|][0-9]') THEN replace(replace(gt, '|', '/'), '/', ',') END AS strict_diploid, CASE WHEN regexp_full_match(gt, '[0-9]([/|][0-9])*') THEN replace(replace(gt, '|', '/'), '/', ',') END AS complete, CASE WHEN gt LIKE '%x%' THEN '' ELSE array_to_string(list_filter(string_split(replace(gt, '|', '/'), '/'), lambda z: z <> '.'), ',') END AS called_lenient FROM g", *_GT),
    "key_value_table": q("SELECT 'targets' AS Item, CAST(count(*) AS VARCHAR) AS Value FROM uni UNION ALL SELECT 'missing', CAST(count(*) AS VARCHAR) FROM miss UNION ALL SELECT 'nested', 'True' UNION ALL SELECT 'nothing', 'NA'"),
}

# What is written as text and read back answers what it answered before.
SQL |= {
    "text_retention_overall": SQL["retention_overall"],
    "text_alt_state_summary": SQL["alt_state_summary"],
    "text_alt_states_from_blocks": SQL["alt_state_summary"],
    "text_carrier_cache": q("SELECT sample_id AS SampleID, bin AS Wild_MAF_bin, count(*) AS Carried_targets, CAST(sum(mc) AS BIGINT) AS Wild_minor_copies FROM dip WHERE carries GROUP BY sample_id, bin", *_G),
    "text_call_rate": SQL["call_rate"],
    "text_threshold_summary": SQL["global_threshold_summary"],
    "text_sampling_order": SQL["random_sampling_order"],
    "text_metadata": q("SELECT sample_id, material, garden, region FROM samples"),
}
