"""Ordered analytics: sessions, patterns, trends, habits, forecasts, anomalies, bi-temporal facts."""

from __future__ import annotations

from ..plans.dialect import Op

_RUNS = "SELECT *, sum(CASE WHEN gap IS NULL OR gap > @gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id) AS gap FROM @mem) g"
_DAILY = "SELECT user_id, CAST(CAST(created_at AS DATE) AS STRING) AS d, count(*) AS n, avg(importance) AS imp FROM @mem GROUP BY user_id, CAST(CAST(created_at AS DATE) AS STRING)"
_X = f"SELECT user_id, d, n, imp, CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS DOUBLE) AS x, count(*) OVER (PARTITION BY user_id) AS days FROM ({_DAILY}) q"
_SLOPE = "(count(*) * sum(x * n) - sum(x) * sum(n)) / CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE)"
_HOUR = "CAST(hour(created_at) AS BIGINT)"
_WORD = "SELECT user_id, word, us, id FROM (SELECT user_id, us, id, tag1 AS word FROM @mem UNION ALL SELECT user_id, us, id, tag2 AS word FROM @mem) w"
GAP = {"gap": 86_400_000_000}

OPS = [
    Op("win1", f"SELECT user_id, CAST(run AS BIGINT) AS run, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS n, round(count(*) / greatest((max(us) - min(us)) / 3600000000.0, 1.0), 8) AS density, #joined(tag1) AS tags FROM ({_RUNS}) r GROUP BY user_id, run", ("mem",), "Sessions by gap.", GAP),
    Op("win2", f"SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM ({_RUNS}) r GROUP BY user_id, run HAVING count(*) > 1", ("mem",), "Event sequences: runs of more than one.", {"gap": 7_200_000_000}),
    Op("win3", f"SELECT user_id, CAST(run AS BIGINT) AS run, CAST(floor((k - 1) / 10.0) AS BIGINT) AS part, count(*) AS n FROM (SELECT user_id, run, row_number() OVER (PARTITION BY user_id, run ORDER BY us, id) AS k FROM ({_RUNS}) r) s GROUP BY user_id, run, CAST(floor((k - 1) / 10.0) AS BIGINT)", ("mem",), "Runs split by gap or by ten members.", {"gap": 3_600_000_000}),
    Op("win5", f"SELECT user_id, hour, n, round(mean, 8) AS mean_gap, round(var, 6) AS var_gap FROM (SELECT user_id, hour, count(*) + 1 AS n, avg(g) AS mean, var_pop(g) AS var FROM (SELECT user_id, {_HOUR} AS hour, (us - lag(us) OVER (PARTITION BY user_id, {_HOUR} ORDER BY us, id)) / 3600000000.0 AS g FROM @mem) a WHERE g IS NOT NULL GROUP BY user_id, hour) b", ("mem",), "Gaps between memories of the same hour."),
    Op("win7", "SELECT user_id, round(avg(CASE WHEN a <= 3 THEN importance END), 8) AS first3, round(avg(CASE WHEN b <= 3 THEN importance END), 8) AS last3 FROM (SELECT user_id, importance, row_number() OVER (PARTITION BY user_id ORDER BY us, id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, id DESC) AS b FROM @mem) x GROUP BY user_id", ("mem",), "First three against last three."),
    Op("win8", "SELECT user_id, CAST(floor((r - 1 - @keep) / 10.0) AS BIGINT) AS part, count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, id DESC) AS r FROM @mem) x WHERE r > @keep GROUP BY user_id, CAST(floor((r - 1 - @keep) / 10.0) AS BIGINT)", ("mem",), "Windows of ten behind the most recent.", {"keep": 5}),
    Op("win9", "SELECT user_id, max(CASE WHEN half = 0 AND k = 1 THEN type END) AS now_type, max(CASE WHEN half = 1 AND k = 1 THEN type END) AS before_type FROM (SELECT user_id, half, type, row_number() OVER (PARTITION BY user_id, half ORDER BY n DESC, type) AS k FROM (SELECT user_id, CASE WHEN r <= 10 THEN 0 ELSE 1 END AS half, type, count(*) AS n FROM (SELECT user_id, type, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, id DESC) AS r FROM @mem) a WHERE r <= 20 GROUP BY user_id, CASE WHEN r <= 10 THEN 0 ELSE 1 END, type) b) c GROUP BY user_id", ("mem",), "Topic shift between the last two windows."),
    Op("win10", "SELECT user_id, tag, CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN t = 2 THEN 1 ELSE 0 END) AS BIGINT) AS late, CASE WHEN sum(CASE WHEN t = 2 THEN 1 ELSE 0 END) >= 1.5 * sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) THEN 'rising' WHEN sum(CASE WHEN t = 2 THEN 1 ELSE 0 END) <= 0.5 * sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT user_id, tag, CASE WHEN r <= floor(n / 3.0) THEN 0 WHEN r <= 2 * floor(n / 3.0) THEN 1 ELSE 2 END AS t FROM (SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY us, id, tag) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM @tag) a) b GROUP BY user_id, tag", ("tag",), "Trends by thirds."),
    Op("win11", f"SELECT user_id, count(*) AS days, round({_SLOPE}, 8) AS slope, round((sum(n) - {_SLOPE} * sum(x)) / count(*) + {_SLOPE} * count(*), 7) AS next FROM ({_X}) q GROUP BY user_id HAVING count(*) > 1", ("mem",), "Least-squares trend of daily counts and the next day."),
    Op("win12", "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, text, lead(role, 1) OVER w AS r1, lead(role, 2) OVER w AS r2, lead(role, 3) OVER w AS r3, lead(role, 4) OVER w AS r4 FROM @turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x WHERE role = 'user' AND coalesce(r1, '') <> 'assistant' AND coalesce(r2, '') <> 'assistant' AND coalesce(r3, '') <> 'assistant' AND coalesce(r4, '') <> 'assistant'", ("turns",), "Turns of a user that none of the next four answers."),
    Op("win13", "SELECT fact_id, id, round(value, 2) AS value FROM (SELECT fact_id, id, value, row_number() OVER (PARTITION BY fact_id ORDER BY from_us DESC, id DESC) AS r FROM @facts) x WHERE r = 1", ("facts",), "Latest of each key."),
    Op("win14", "SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, id DESC) AS r FROM @mem) x WHERE r <= @keep", ("mem",), "The newest of each key.", {"keep": 10}),
    Op("win16", "SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS BIGINT) AS place FROM @mem", ("mem",), "Ranks within a user."),
    Op("tmp1", f"SELECT user_id, hour, n FROM (SELECT user_id, hour, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS r FROM (SELECT user_id, {_HOUR} AS hour, count(*) AS n FROM @mem GROUP BY user_id, {_HOUR}) a) b WHERE r = 1", ("mem",), "Peak hour."),
    Op("tmp1_period", f"SELECT user_id, CASE WHEN h >= 5 AND h < 8 THEN 'early_morning' WHEN h >= 8 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 21 THEN 'evening' WHEN h >= 21 OR h = 0 THEN 'night' ELSE 'late_night' END AS period, count(*) AS n FROM (SELECT user_id, {_HOUR} AS h FROM @mem) x GROUP BY user_id, CASE WHEN h >= 5 AND h < 8 THEN 'early_morning' WHEN h >= 8 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 21 THEN 'evening' WHEN h >= 21 OR h = 0 THEN 'night' ELSE 'late_night' END", ("mem",), "Periods of the day."),
    Op("tmp2", f"SELECT user_id, hour, n, round(1 - v / 576.0, 8) AS regularity, last_us + 86400000000 AS next_us FROM (SELECT user_id, hour, count(*) + 1 AS n, count(DISTINCT d) AS days, var_pop(g) AS v, max(us) AS last_us FROM (SELECT user_id, {_HOUR} AS hour, CAST(created_at AS DATE) AS d, us, (us - lag(us) OVER (PARTITION BY user_id, {_HOUR} ORDER BY us, id)) / 3600000000.0 AS g FROM @mem) a WHERE g IS NOT NULL GROUP BY user_id, hour) b WHERE n >= 4 AND days >= 3", ("mem",), "Daily patterns, every hour that qualifies."),
    Op("tmp3", "SELECT user_id, dow, n, round(1 - v / 49.0, 8) AS regularity, last_us + 604800000000 AS next_us FROM (SELECT user_id, dow, count(*) + 1 AS n, var_pop(g) AS v, max(us) AS last_us FROM (SELECT user_id, dow, us, (us - lag(us) OVER (PARTITION BY user_id, dow ORDER BY us, id)) / 8.64E10 AS g FROM (SELECT user_id, id, us, CAST(#dow(created_at) AS BIGINT) AS dow FROM @mem) z) a WHERE g IS NOT NULL GROUP BY user_id, dow) b WHERE n >= 3", ("mem",), "Weekly patterns."),
    Op("tmp5", "SELECT user_id, CASE WHEN late > early * 1.1 THEN 'increasing' WHEN late < early * 0.9 THEN 'decreasing' ELSE 'stable' END AS importance_trend, kinds_early, kinds_late FROM (SELECT user_id, avg(CASE WHEN age > 15 THEN importance END) AS early, avg(CASE WHEN age <= 15 THEN importance END) AS late, count(DISTINCT CASE WHEN age > 15 THEN type END) AS kinds_early, count(DISTINCT CASE WHEN age <= 15 THEN type END) AS kinds_late FROM @mem GROUP BY user_id) x", ("mem",), "Trends of importance and of type diversity."),
    Op("tmp6", "SELECT user_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, round(count(*) / greatest(1.0, (max(us) - min(us)) / 86400000000.0), 8) AS per_day FROM @mem GROUP BY user_id", ("mem",), "Temporal summary."),
    Op("tmp7", "SELECT user_id, CAST(CAST(created_at AS DATE) AS STRING) AS day, #ordered(id, text) AS story FROM @mem GROUP BY user_id, CAST(CAST(created_at AS DATE) AS STRING)", ("mem",), "Chronological narrative by day."),
    Op("tmp8", "SELECT id, created_at, CASE type WHEN 'fact' THEN 'milestone' WHEN 'preference' THEN 'decision' WHEN 'habit' THEN 'routine' WHEN 'event' THEN 'incident' ELSE 'observation' END AS kind FROM @mem", ("mem",), "Timeline entries by kind."),
    Op("tmp9", "SELECT id, #us(due) AS due_us FROM (SELECT id, created_at AS due FROM @mem WHERE created_at <= TIMESTAMP '2024-01-10 00:00:00' AND tag1 = 'signup') x", ("mem",), "Scheduled memories that are due."),
    Op("dat2", f"SELECT id, {_HOUR} AS hour, CAST(#dow(created_at) AS BIGINT) AS dow, CAST(month(created_at) AS BIGINT) AS month, CAST(year(created_at) AS BIGINT) AS year FROM @mem", ("mem",), "Calendar fields."),
    Op("dat4", "SELECT id, #us(created_at) + CASE tag1 WHEN 'click' THEN 86400000000 WHEN 'view' THEN 604800000000 ELSE 2592000000000 END AS next_us FROM @mem", ("mem",), "Next time of a recurrence."),
    Op("dat5", "SELECT id, #hours(created_at, 5) AS local_at FROM @mem", ("mem",), "Shift by a time zone's offset."),
    Op("ins1", f"SELECT user_id, word, n, round(gap, 8) AS gap, CASE WHEN gap < 2 THEN 'daily' WHEN gap < 8 THEN 'weekly' WHEN gap < 35 THEN 'monthly' ELSE 'occasional' END AS rhythm FROM (SELECT user_id, word, count(*) + 1 AS n, avg(g) AS gap FROM (SELECT user_id, word, (us - lag(us) OVER (PARTITION BY user_id, word ORDER BY us, id)) / 86400000000.0 AS g FROM ({_WORD}) a) b WHERE g IS NOT NULL GROUP BY user_id, word) c WHERE n >= 3", ("mem",), "Recurring keywords."),
    Op("ins2", "SELECT user_id, tag1, next_tag, count(*) AS n FROM (SELECT user_id, tag1, lead(tag1) OVER w AS next_tag, (lead(us) OVER w) - us AS gap FROM @mem WINDOW w AS (PARTITION BY user_id ORDER BY us, id)) x WHERE gap <= 21600000000 GROUP BY user_id, tag1, next_tag HAVING count(*) >= 3", ("mem",), "Sequential pairs of tags."),
    Op("ins3", "SELECT user_id, tag, count(*) AS sessions FROM (SELECT user_id, session_id, tag, row_number() OVER (PARTITION BY user_id, session_id ORDER BY n DESC, tag) AS r FROM (SELECT user_id, session_id, tag, count(*) AS n FROM @tag GROUP BY user_id, session_id, tag) a) b WHERE r = 1 GROUP BY user_id, tag HAVING count(*) >= 3", ("tag",), "Tags that dominate several sessions."),
    Op("ins4", "SELECT user_id, type, CAST(sum(CASE WHEN age > 15 THEN 1 ELSE 0 END) AS BIGINT) AS before_n, CAST(sum(CASE WHEN age <= 15 THEN 1 ELSE 0 END) AS BIGINT) AS after_n FROM @mem GROUP BY user_id, type HAVING sum(CASE WHEN age <= 15 THEN 1 ELSE 0 END) >= 2 * sum(CASE WHEN age > 15 THEN 1 ELSE 0 END) OR sum(CASE WHEN age > 15 THEN 1 ELSE 0 END) >= 2 * sum(CASE WHEN age <= 15 THEN 1 ELSE 0 END)", ("mem",), "Behaviour changes."),
    Op("ins5", "SELECT user_id, type, first_text, last_text, CASE WHEN first_text = last_text THEN 0.0 ELSE 1.0 END AS moved FROM (SELECT user_id, type, max(CASE WHEN a = 1 THEN text END) AS first_text, max(CASE WHEN b = 1 THEN text END) AS last_text FROM (SELECT user_id, type, text, row_number() OVER (PARTITION BY user_id, type ORDER BY us, id) AS a, row_number() OVER (PARTITION BY user_id, type ORDER BY us DESC, id DESC) AS b FROM @mem) x GROUP BY user_id, type) y", ("mem",), "Preference drift between the first and the last."),
    Op("ins6", "SELECT user_id, tag, n, round(0.4 / (1 + v) + 0.4 * least(n / 20.0, 1.0) + 0.2 * exp(-last_age / 30.0), 8) AS score FROM (SELECT user_id, tag, count(*) + 1 AS n, var_pop(g) AS v, min(age) AS last_age FROM (SELECT user_id, tag, age, (us - lag(us) OVER (PARTITION BY user_id, tag ORDER BY us, id)) / 86400000000.0 AS g FROM @tag) a WHERE g IS NOT NULL GROUP BY user_id, tag) b", ("tag",), "Habit scores."),
    Op("prd1", "SELECT user_id, recent, round(base, 8) AS base, CASE WHEN recent > 2 * base THEN 'burst' WHEN recent < 0.5 * base THEN 'lull' ELSE 'normal' END AS state, round(shift, 8) AS importance_shift FROM (SELECT user_id, CAST(sum(CASE WHEN age <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS recent, sum(CASE WHEN age > 10 THEN 1 ELSE 0 END) / 2.0 AS base, avg(CASE WHEN age <= 10 THEN importance END) - avg(CASE WHEN age > 10 THEN importance END) AS shift FROM @mem GROUP BY user_id) x", ("mem",), "Anomalies of rate and importance."),
    Op("prd2", f"SELECT user_id, round(avg(n), 8) AS forecast, round(greatest(0.0, avg(n) - 1.96 * stddev_pop(n)), 7) AS low, round(avg(n) + 1.96 * stddev_pop(n), 7) AS high FROM ({_X}) q WHERE x >= days - 7 GROUP BY user_id", ("mem",), "Activity forecast from the last seven observed days."),
    Op("prd4", "SELECT user_id, type, CAST(month(created_at) AS BIGINT) AS month, count(*) AS n FROM @mem GROUP BY user_id, type, CAST(month(created_at) AS BIGINT) HAVING count(*) >= 3", ("mem",), "Seasonal counts."),
    Op("adp1", "SELECT user_id, tag, n, CASE WHEN n >= 20 THEN 'frequent' WHEN sd / mean < 0.3 THEN 'periodic' WHEN last_age > 20 THEN 'declining' WHEN sd / mean > 1.5 THEN 'burst' ELSE 'sporadic' END AS pattern FROM (SELECT user_id, tag, count(*) + 1 AS n, avg(g) AS mean, stddev_pop(g) AS sd, min(age) AS last_age FROM (SELECT user_id, tag, age, (us - lag(us) OVER (PARTITION BY user_id, tag ORDER BY us, id)) / 3600000000.0 AS g FROM @tag) a WHERE g IS NOT NULL GROUP BY user_id, tag) b WHERE mean > 0", ("tag",), "Access patterns, in order of precedence."),
    Op("bt1", "SELECT id, fact_id FROM @facts WHERE from_us <= @at AND (to_us IS NULL OR @at < to_us)", ("facts",), "Facts valid at a point in time.", {"at": 800000000000000}),
    Op("bt2", "SELECT id, fact_id FROM @facts WHERE from_us < @until AND (to_us IS NULL OR to_us > @from)", ("facts",), "Facts valid in an interval.", {"from": 795000000000000, "until": 800000000000000}),
    Op("bt3", "SELECT id, fact_id, round(value, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY from_us DESC, id DESC) AS r FROM @facts WHERE from_us <= @at AND status <> 'P') x WHERE r = 1", ("facts",), "What the system knew at a time.", {"at": 850000000000000}),
    Op("bt4", "SELECT id, fact_id, from_us, coalesce(to_us, CASE WHEN fact_id % 2 = 0 THEN @at ELSE -1 END) AS to_us, CASE WHEN to_us IS NOT NULL THEN 'superseded' WHEN fact_id % 2 = 0 THEN 'retracted' ELSE 'active' END AS state FROM @facts", ("facts",), "Revisions and retractions.", {"at": 906000000000000}),
    Op("bt5", "SELECT fact_id, count(*) AS versions, #ordered(from_us, CAST(id AS STRING)) AS history FROM @facts GROUP BY fact_id HAVING count(DISTINCT from_us) = count(*)", ("facts",), "History of each fact."),
    Op("bt6", "SELECT fact_id, id FROM @facts WHERE to_us IS NULL", ("facts",), "Currently valid facts."),
]
