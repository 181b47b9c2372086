"""Scoring kernels over events as rollouts."""

from pyspark.sql import functions as F

from quern.operators import scoring as S
from quern.queries.base import query


def r(name, digits=6):
    return F.round(name, digits).alias(name)


ADV = """SELECT id, grp, n AS group_size, round(m, 6) AS mean_reward, round(s, 6) AS reward_std, round((reward - m) / (s + 0.000001), 6) AS advantage,
  CASE WHEN m = 0 THEN 'all_zero' WHEN m = 1 THEN 'all_one' ELSE 'mixed' END AS group_kind
FROM (SELECT id, grp, reward, count(*) OVER w AS n, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s FROM {rollouts} WINDOW w AS (PARTITION BY grp)) WHERE n > 1"""


@query(ADV)
def k1_group_advantages(t):
    return S.group_advantages(t("rollouts"), "grp", "reward").select("id", "grp", "group_size", r("mean_reward"), r("reward_std"), r("advantage"), "group_kind")


@query("""SELECT id, round(m, 6) AS mean_reward, round((shaped - m) / (s + 0.000001), 5) AS advantage, CASE WHEN o = 0 THEN 'all_zero' WHEN o = 1 THEN 'all_one' ELSE 'mixed' END AS group_kind
FROM (SELECT *, count(*) OVER w AS n, avg(shaped) OVER w AS m, stddev_pop(shaped) OVER w AS s, avg(reward) OVER w AS o
  FROM (SELECT id, grp, reward, reward * (1 + turns / 10.0::DOUBLE) AS shaped FROM {rollouts}) WINDOW w AS (PARTITION BY grp)) WHERE n > 1""")
def k2_shaped_advantages(t):
    df = t("rollouts").withColumn("shaped", F.col("reward") * (1 + F.col("turns") / 10))
    return S.group_advantages(df, "grp", "shaped", outcome="reward").select("id", r("mean_reward"), r("advantage", 5), "group_kind")


@query("""SELECT id, round(CASE WHEN n = 1 THEN 0 ELSE (rk + (ties - 1) / 2.0 - (n - 1) / 2.0) / ((n - 1) / 2.0) END, 6) AS centered_rank
FROM (SELECT id, rank() OVER (PARTITION BY grp ORDER BY schema_score) - 1 AS rk, count(*) OVER (PARTITION BY grp, schema_score) AS ties, count(*) OVER (PARTITION BY grp) AS n FROM {rollouts})""")
def k3_tied_centered_ranks(t):
    return t("rollouts").select("id", F.round(S.tied_centered_rank("schema_score", "grp"), 6).alias("centered_rank"))


@query("""WITH a AS (SELECT *, count(*) OVER w AS n, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s FROM {rollouts} WINDOW w AS (PARTITION BY grp)),
b AS (SELECT *, (reward - m) / (s + 0.000001) AS adv, reward = 0 AS failed FROM a WHERE n > 1),
c AS (SELECT *, count(*) OVER (PARTITION BY grp, failed) AS k,
  rank() OVER (PARTITION BY grp, failed ORDER BY schema_score) - 1 + (count(*) OVER (PARTITION BY grp, failed, schema_score) - 1) / 2.0 AS sr,
  rank() OVER (PARTITION BY grp, failed ORDER BY submission) - 1 + (count(*) OVER (PARTITION BY grp, failed, submission) - 1) / 2.0 AS ur FROM b),
d AS (SELECT *, CASE WHEN failed AND k > 1 THEN (sr - (k - 1) / 2.0) / ((k - 1) / 2.0) ELSE 0 END AS schema_rank,
  CASE WHEN failed AND k > 1 THEN (ur - (k - 1) / 2.0) / ((k - 1) / 2.0) ELSE 0 END AS submission_rank FROM c),
e AS (SELECT *, adv + 0.2 * schema_rank + 0.1 * submission_rank AS total FROM d)
SELECT id, round(schema_rank, 6) AS schema_rank, round(submission_rank, 6) AS submission_rank, round(total, 5) AS total_advantage, round(reward + (1 - reward) * 0.05 * schema_score, 6) AS diagnostic,
  m = 0 AND max(total) OVER (PARTITION BY grp) > min(total) OVER (PARTITION BY grp) AS rescued FROM e""")
def k4_hierarchical_advantages(t):
    out = S.hierarchical_advantages(t("rollouts"), "grp", "reward", "schema_score", "submission", 0.2, 0.1)
    return out.select("id", r("schema_rank"), r("submission_rank"), r("total_advantage", 5), r("diagnostic"), "rescued")


@query("""WITH g AS (SELECT grp, count(*) AS n, avg(reward) AS m, stddev_pop(reward) AS s FROM {rollouts} GROUP BY grp HAVING count(*) > 1)
SELECT count(*) AS groups, count(*) FILTER (m = 0) AS all_zero_groups, count(*) FILTER (m = 1) AS all_one_groups, count(*) FILTER (m > 0 AND m < 1) AS mixed_groups,
 round(count(*) FILTER (m = 0) / count(*), 6) AS all_zero_ratio, round(count(*) FILTER (m = 1) / count(*), 6) AS all_one_ratio, round(count(*) FILTER (m > 0 AND m < 1) / count(*), 6) AS mixed_ratio,
 round(avg(s), 6) AS mean_reward_std, round(avg(m), 6) AS mean_reward FROM g""")
def k5_group_summary(t):
    out = S.summarize_groups(t("rollouts"), "grp", "reward")
    counts = ["groups", "all_zero_groups", "all_one_groups", "mixed_groups"]
    return out.select(*counts, *(r(c) for c in out.columns if c not in counts))


@query("""SELECT id, round(CASE WHEN reward = 1 THEN 1 + 0.1 * (CASE difficulty WHEN 'easy' THEN 4 WHEN 'medium' THEN 5 WHEN 'hard' THEN 7 ELSE 8 END - turns) ELSE 0 END, 6)::DOUBLE AS reward FROM {leveled}""")
def k6_turn_reward(t):
    return t("leveled").select("id", F.round(S.turn_reward(F.col("reward") == 1, F.col("difficulty"), F.col("turns")), 6).alias("reward"))


WORDS = """WITH a AS (SELECT id, list_distinct(list_slice(string_split(text, ' '), 1, 12)) AS c, list_distinct(list_slice(string_split(text, ' '), 7, 20)) AS g FROM {corpus}),
b AS (SELECT *, len(list_intersect(c, g))::DOUBLE AS o, len(c)::DOUBLE AS nc, len(g)::DOUBLE AS ng FROM a) """


@query(WORDS + """SELECT id, round(CASE WHEN nc = 0 AND ng = 0 THEN 1 WHEN nc = 0 OR ng = 0 THEN 0 ELSE o / nc END, 6) AS "precision",
round(CASE WHEN nc = 0 AND ng = 0 THEN 1 WHEN nc = 0 OR ng = 0 THEN 0 ELSE o / ng END, 6) AS recall,
round(CASE WHEN nc = 0 AND ng = 0 THEN 1 WHEN nc = 0 OR ng = 0 OR o = 0 THEN 0 ELSE 2 * (o / nc) * (o / ng) / (o / nc + o / ng) END, 6) AS f1 FROM b""")
def k8_f1(t):
    words = F.split("text", " ", -1)
    return t("corpus").select("id", S.f1(F.slice(words, 1, 12), F.slice(words, 7, 14)).alias("s")).select("id", F.round("s.precision", 6).alias("precision"), F.round("s.recall", 6).alias("recall"), F.round("s.f1", 6).alias("f1"))


@query("""SELECT id, round((CASE WHEN turns > 2 THEN 1.0 WHEN turns > 1 THEN 0.25 ELSE 0 END) * (CASE WHEN origin = 'error' THEN 0 ELSE 1 END)
 * (CASE WHEN d > 1 THEN 0.3 * schema_score + 0.4 * submission + 0.3 * reward ELSE 0.5 * schema_score + 0.5 * submission END), 6)::DOUBLE AS schema_score FROM {rollouts}""")
def k9_schema_score(t):
    source = F.when(F.col("origin") == "error", "none").otherwise("execute_sql")
    score = S.schema_score(F.col("schema_score"), F.col("submission"), F.col("reward"), F.col("turns") > 2, F.col("turns") > 1, source, F.col("d"), single=(0.5, 0.5, 0.0), multi=(0.3, 0.4, 0.3))
    return t("rollouts").select("id", F.round(score, 6).alias("schema_score"))


@query("""WITH e AS (SELECT grp, turns AS ep, count(*) AS tokens FROM {rollouts} GROUP BY ALL), s AS (SELECT grp, count(*) AS k FROM e GROUP BY grp), n AS (SELECT count(*) AS g FROM s)
SELECT id, round(1.0::DOUBLE / (g * k), 9) AS episode_weight, round(1.0::DOUBLE / tokens, 9) AS token_weight FROM {rollouts} r JOIN e ON r.grp = e.grp AND r.turns = e.ep JOIN s ON r.grp = s.grp, n""")
def k10_episode_weights(t):
    return S.episode_weights(t("rollouts"), "grp", "turns").select("id", r("episode_weight", 9), r("token_weight", 9))


TOKENS = """WITH tok AS (SELECT id, origin, advantage, 0 AS pos, cur0 AS cur, old0 AS old, ref0 AS ref, TRUE AS keep FROM {token_rows} UNION ALL SELECT id, origin, advantage, 1, cur1, old1, ref1, keep1 FROM {token_rows}),
x AS (SELECT *, exp(greatest(-20, least(20, cur - old))) AS ratio, exp(greatest(-20, least(20, ref - cur))) - greatest(-20, least(20, ref - cur)) - 1 AS kl FROM tok),
y AS (SELECT *, greatest(0.8, least(1.3, ratio)) AS b FROM x),
z AS (SELECT *, ratio <> b AS clipped, (advantage > 0 AND ratio > 1.3) OR (advantage < 0 AND ratio < 0.8) AS policy_clipped, -least(ratio * advantage, b * advantage) AS policy_loss FROM y) """


def tokens(t):
    """The tokens of all rows, in one pass over the table, with their losses."""
    rows = t("token_rows")
    each = F.array(*(F.struct(F.lit(i).alias("pos"), F.col(f"cur{i}").alias("cur"), F.col(f"old{i}").alias("old"), F.col(f"ref{i}").alias("ref"), (F.lit(True) if i == 0 else F.col("keep1")).alias("keep")) for i in (0, 1)))
    rows = rows.select("id", "origin", "advantage", F.explode(each).alias("x")).select("id", "origin", "advantage", "x.*")
    return rows.withColumns(S.token_loss(F.col("cur"), F.col("old"), F.col("ref"), F.col("advantage"), 0.2, 0.3, 0.05))


@query(TOKENS + "SELECT id, pos, round(policy_loss, 6) + 0.0 AS policy_loss, round(kl, 6) AS kl, round(policy_loss + 0.05 * kl, 6) + 0.0 AS loss, clipped, policy_clipped FROM z")
def k11_token_loss(t):
    plus = F.lit(0.0)  # so that no zero is negative
    return tokens(t).select("id", "pos", (r("policy_loss") + plus).alias("policy_loss"), r("kl"), (r("loss") + plus).alias("loss"), "clipped", "policy_clipped")


@query(TOKENS + "SELECT origin, count(*) FILTER (policy_clipped AND keep AND advantage <> 0) AS clipped, count(*) FILTER (keep AND advantage <> 0) AS eligible, count(*) FILTER (clipped AND keep) AS outside, count(*) FILTER (keep) AS tokens FROM z GROUP BY origin")
def k12_clip_counts(t):
    return S.clip_counts(tokens(t), "origin", "advantage", "keep")


@query("""SELECT id, round(x[1] - (m + ln(list_sum([exp(y - m) FOR y IN x]))), 6) AS logp FROM (SELECT id, [cur0, old0, ref0, cur1] AS x, greatest(cur0, old0, ref0, cur1) AS m FROM {token_rows})""")
def k13_selected_log_prob(t):
    """Log-probability of a chosen logit: gather minus the stable log of the sum of exponentials."""
    logits = F.array("cur0", "old0", "ref0", "cur1")
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return t("token_rows").select("id", F.round(logits[0] - (top + F.ln(total)), 6).alias("logp"))


@query("""SELECT id, (id % 5 NOT IN (0, 2))::INT + (id % 7 NOT IN (0, 2))::INT + (id % 3 NOT IN (0, 2))::INT AS kept FROM {rollouts}""")
def k14_action_mask(t):
    ids = F.array(*((F.col("id") % k).cast("int") for k in (5, 7, 3)))
    return t("rollouts").select("id", F.size(F.filter(S.action_mask(ids, [0, 2]), lambda x: x)).alias("kept"))


@query("""SELECT id, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS loss FROM (SELECT id, -0.1 * ((cur0 + CASE WHEN keep1 THEN cur1 ELSE 0 END - old0 - CASE WHEN keep1 THEN old1 ELSE 0 END) - (ref0 - ref1)) AS x FROM {token_rows})""")
def k15_preference_loss(t):
    mask = F.array(F.lit(True), F.col("keep1"))
    chosen, rejected = S.masked_sum(F.array("cur0", "cur1"), mask), S.masked_sum(F.array("old0", "old1"), mask)
    return t("token_rows").select("id", F.round(S.preference_loss(chosen, rejected, F.col("ref0"), F.col("ref1")), 6).alias("loss"))


@query("""SELECT grp, round(sum(value / n) / sum(1.0::DOUBLE / n), 4) AS weighted FROM (SELECT grp, value, count(*) OVER (PARTITION BY grp, turns) AS n FROM {rollouts}) GROUP BY grp""")
def k16_trajectory_weighted_loss(t):
    """Mean loss where a trajectory's tokens share one weight."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("grp", "turns"))
    df = t("rollouts").withColumn("w", 1 / n)
    return df.groupBy("grp").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 4).alias("weighted"))


@query("""SELECT step, round(CASE WHEN step <= 100 THEN 0.001 * step / 100 ELSE 0.001 * 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (step - 100)::DOUBLE / 9900)))) END, 9)::DOUBLE AS rate FROM (SELECT event_id + 1 AS step FROM events)""")
def k17_learning_rate(t):
    """Each event as a step."""
    step = F.col("event_id") + 1
    return t("events").select(step.alias("step"), F.round(S.learning_rate(step, 0.001, 100, 10_000), 9).alias("rate"))


@query("""WITH w AS (SELECT id, string_split(text, ' ') AS p, strpos(text, 'e') AS first FROM {corpus}),
x AS (SELECT id, first, p, [list_sum([len(y) + 1 FOR y IN list_slice(p, 1, i - 1)]) FOR i IN range(1, len(p) + 1)] AS s FROM w)
SELECT id, len([i FOR i IN range(1, len(s) + 1) IF coalesce(s[i], 0) < first + 29 AND coalesce(s[i], 0) + len(p[i]) > first - 1]) AS inside FROM x""")
def k18_tokens_inside(t):
    """Tokens of the whole text that overlap the thirty characters from the first e on: one fold gives their places and counts them."""

    def step(x, w):
        end = x["at"] + F.char_length(w)
        inside = S.overlaps(x["at"], end, x["first"] - 1, x["first"] + 29)
        return F.struct((end + 1).alias("at"), (x["n"] + inside.cast("long")).alias("n"), x["first"].alias("first"))

    # The first e is looked for once, not at each token.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.instr("text", "e").alias("first"))
    return t("corpus").select("id", F.aggregate(F.split("text", " ", -1), start, step, lambda x: x["n"]).alias("inside"))


@query("""SELECT grp, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT grp, origin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY grp) AS p FROM {rollouts} GROUP BY grp, origin) GROUP BY grp""")
def k19_entropy(t):
    """Shannon entropy of a group's outcomes."""
    counts = t("rollouts").groupBy("grp", "origin").count().groupBy("grp").agg(F.collect_list(F.col("count").cast("double")).alias("c"))
    share = F.transform("c", lambda x: x / F.aggregate("c", F.lit(0.0), lambda a, y: a + y))
    return counts.select("grp", F.round(S.entropy(share), 6).alias("entropy"))


@query("""SELECT id, round(-list_sum([(exp(y) / z) * ln(exp(y) / z) FOR y IN x]), 6) AS entropy FROM (SELECT id, x, list_sum([exp(y) FOR y IN x]) AS z FROM (SELECT id, [cur0, old0, cur1, old1] AS x FROM {token_rows}))""")
def k19_softmax_entropy(t):
    return t("token_rows").select("id", F.round(S.entropy(S.softmax(F.array("cur0", "old0", "cur1", "old1"))), 6).alias("entropy"))


@query("""SELECT origin, count(*) AS calls, sum(turns)::BIGINT AS tokens, round(avg(value / turns), 4) AS call_mean_nats, round(sum(value) / sum(turns), 4) AS token_mean_nats, round(sum(value) / sum(turns) / ln(2), 4) AS token_mean_bits FROM {rollouts} GROUP BY origin""")
def k20_entropy_summary(t):
    out = S.entropy_summary(t("rollouts"), "turns", "value", "origin")
    return out.select("origin", "calls", "tokens", r("call_mean_nats", 4), r("token_mean_nats", 4), r("token_mean_bits", 4))
