"""DuckDB counterparts of the registered queries.

Written apart from the Spark plans: sessions by lag over all events, baselines by self-joins,
similarity on whole texts.
"""

from __future__ import annotations

from userbaseline.models.text_features import COMPONENTS
from userbaseline.plans.catalog import SILENT, SMALL_CHUNK, TEST_FROM
from userbaseline.sources.tenants import AS_OF, FIRST_DAY, LOST_KEY_COMPANY, OPT_IN_DAYS


def _id(value: str) -> str:
    return f"md5({value})"


def _day(column: str = "dy") -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def _ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


# each entry may use the ones named before it
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    _CTES[name] = (needs, sql)


def _with(body: str, *needs: str, replaced: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``body`` after the CTEs it needs; ``replaced`` gives some of them another meaning."""
    ctes = {**_CTES, **(replaced or {})}
    wanted: list[str] = []

    def add(name: str) -> None:
        for inner in ctes[name][0]:
            add(inner)
        if name not in wanted:
            wanted.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n][1]})" for n in wanted) + "\n" + body


_cte(
    "lagged",
    """SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events""",
)
_cte(
    "numbered",
    """SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
       OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM lagged""",
    "lagged",
)
_cte(
    "tagged",
    """SELECT *, min(event_id) OVER w AS session_id, min(ts) OVER w AS start_ts
       FROM numbered WINDOW w AS (PARTITION BY user_id, no)""",
    "numbered",
)
_cte(
    "all_sess",
    f"""SELECT *, {_id("CASE WHEN violations > 0 THEN 'error' ELSE 'view' END")} AS user_ref,
       {_id("CASE WHEN commands_count > 1 THEN 'click' END")} AS ports_ref,
       {_id("CASE WHEN violations > 0 THEN 'nobody' ELSE 'purchase' END")} AS created_by_ref,
       {_id("""'signup {"k": ' || commands_count || '}'""")} AS ip_ref FROM
       (SELECT session_id, user_id, start_ts, max(ts) AS last_ts, CAST(start_ts AS DATE) AS dy,
       strftime(start_ts, '%Y%m%d%H') AS stamp, session_id % 10 AS server_id, session_id % 30 AS ip_id,
       count(*) AS commands_count, count(*) FILTER (event_type = 'error') AS violations,
       count(*) FILTER (event_type IN ('error', 'signup')) AS triggered_total
       FROM tagged GROUP BY session_id, user_id, start_ts)""",
    "tagged",
)
_cte(
    "all_cmds",
    """SELECT event_id AS cmd_id, session_id, user_id, ts, CAST(start_ts AS DATE) AS dy,
       event_type || ' ' || props AS cmd, event_type AS cmd_root, props AS parameters,
       CASE WHEN event_type = 'error' THEN 'BAD' ELSE 'GOOD' END AS cmd_rep FROM tagged""",
    "tagged",
)
_cte("sess", "SELECT * FROM all_sess", "all_sess")
_cte("cmds", "SELECT * FROM all_cmds", "all_cmds")
_cte(
    "srv",
    f"""SELECT s_suppkey AS server_id, CAST(s_nationkey AS BIGINT) AS project_id,
       {_id("n_name")} AS hostname_ref, {_id("r_name")} AS host_ip_ref
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
_cte(
    "placed",
    """SELECT all_sess.*, srv.project_id, srv.hostname_ref, srv.host_ip_ref
       FROM all_sess JOIN srv USING (server_id)""",
    "all_sess",
    "srv",
)
_cte(
    "periods",
    f"""SELECT CAST(n_nationkey AS BIGINT) AS project_id,
       TIMESTAMP '{FIRST_DAY}' + to_days(CAST(n_nationkey % 7 AS INTEGER)) AS start_date,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL
       ELSE TIMESTAMP '{FIRST_DAY}' + to_days(CAST(n_nationkey % 7 + {OPT_IN_DAYS} AS INTEGER)) END AS end_date
       FROM nation
       UNION ALL
       SELECT CAST(n_nationkey AS BIGINT), TIMESTAMP '{FIRST_DAY}' + to_days(CAST(n_nationkey % 7 + 5 AS INTEGER)), NULL
       FROM nation WHERE n_nationkey % 5 = 0""",
)
_INSIDE = f"""p.project_id = s.project_id AND date_trunc('minute', s.start_ts)
    BETWEEN p.start_date AND coalesce(p.end_date, TIMESTAMP '{AS_OF}')"""
_cte(
    "geo",
    f"""SELECT s.*, n_name AS country_name,
       CASE WHEN n_nationkey IS NULL THEN NULL WHEN n_nationkey % 2 = 0 THEN 'fixed' ELSE 'mobile' END AS ip_type,
       CASE WHEN n_nationkey IS NULL THEN NULL WHEN n_nationkey % 3 = 0 THEN 'click'
            WHEN n_nationkey % 3 = 1 THEN 'view' ELSE 'nowhere' END AS latitude_text,
       CASE WHEN n_nationkey IS NOT NULL THEN 'error' END AS longitude_text,
       n_nationkey AS place, n_regionkey AS continent
       FROM placed s LEFT JOIN nation ON s.ip_id = n_nationkey""",
    "placed",
)
# values of each project; those of the company with the lost key cannot be read
_cte(
    "pcmds",
    "SELECT cmds.*, srv.project_id FROM cmds JOIN srv ON cmds.session_id % 10 = srv.server_id",
    "cmds",
    "srv",
)
_cte(
    "vals",
    """SELECT project_id, cmd AS value FROM pcmds UNION SELECT project_id, cmd_root FROM pcmds
       UNION SELECT project_id, parameters FROM pcmds
       UNION SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation
       UNION SELECT CAST(n_nationkey AS BIGINT), r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "pcmds",
)
_cte(
    "dict",
    f"""SELECT project_id, {_id("value")} AS id,
       CASE WHEN n_regionkey = {LOST_KEY_COMPANY} THEN NULL ELSE value END AS value
       FROM vals JOIN nation ON project_id = n_nationkey""",
    "vals",
)


def _role(fact: str, ref: str) -> str:
    return f"(SELECT value FROM dict d WHERE d.project_id = {fact}.project_id AND d.id = {fact}.{ref})"


_SESSION_DECODE = f"""SELECT session_id, project_id,
    coalesce({_role("s", "hostname_ref")}, '') AS hostname,
    coalesce({_role("s", "host_ip_ref")}, '') AS host_ip,
    {_role("s", "user_ref")} AS "user",
    coalesce({_role("s", "ip_ref")}, '') AS ip,
    coalesce({_role("s", "ports_ref")}, '') AS ports,
    coalesce({_role("s", "created_by_ref")}, '') AS created_by
    FROM placed s"""

# --- series: (user_id, dy, v) --------------------------------------------------------------------

_cte("s_sessions", "SELECT user_id, dy, count(DISTINCT session_id) AS v FROM sess GROUP BY ALL", "sess")
_cte("per_sess", "SELECT session_id, count(lower(cmd)) AS cmds FROM cmds GROUP BY ALL", "cmds")
_cte(
    "s_commands",
    "SELECT user_id, dy, avg(cmds) AS v FROM sess JOIN per_sess USING (session_id) GROUP BY ALL",
    "sess",
    "per_sess",
)
_cte(
    "dur",
    "SELECT session_id, user_id, dy, date_sub('second', date_trunc('second', start_ts), last_ts) AS seconds FROM sess",
    "sess",
)
_cte("s_duration", "SELECT user_id, dy, avg(seconds) AS v FROM dur GROUP BY ALL", "dur")
_cte(
    "rep",
    """SELECT session_id, count(*) FILTER (cmd_rep = 'GOOD') AS good, count(*) FILTER (cmd_rep = 'BAD') AS bad,
       count(*) AS total FROM cmds GROUP BY ALL""",
    "cmds",
)
_cte(
    "rep_day",
    """SELECT user_id, dy, avg(total) AS mean_total, avg(good) AS mean_good, avg(bad) AS mean_bad
       FROM sess JOIN rep USING (session_id) GROUP BY ALL""",
    "sess",
    "rep",
)
_cte("s_good", "SELECT user_id, dy, mean_good / mean_total AS v FROM rep_day", "rep_day")
_cte("s_bad", "SELECT user_id, dy, mean_bad / mean_total AS v FROM rep_day", "rep_day")
_cte(
    "texts",
    "SELECT user_id, dy, string_agg(lower(cmd), ' ' ORDER BY ts, cmd_id) AS txt FROM cmds GROUP BY ALL",
    "cmds",
)


def _similar(texts: str) -> str:
    return f"""SELECT user_id, dy, CASE WHEN prev IS NULL THEN 1.0
       ELSE 1.0 - CAST(levenshtein(txt, prev) AS DOUBLE) / greatest(length(txt), length(prev)) END AS v
       FROM (SELECT *, lag(txt) OVER (PARTITION BY user_id ORDER BY dy) AS prev FROM {texts})"""


_cte("s_match", _similar("texts"), "texts")
_cte(
    "first_texts",
    """SELECT c.user_id, c.dy, string_agg(lower(cmd), ' ' ORDER BY ts, cmd_id) AS txt FROM cmds c
       JOIN (SELECT user_id, dy, arg_min(session_id, (start_ts, session_id)) AS session_id FROM sess GROUP BY ALL) f
       USING (session_id) GROUP BY ALL""",
    "cmds",
    "sess",
)
_cte("s_match_first", _similar("first_texts"), "first_texts")


def _baseline(tag: str, series: str) -> None:
    """CTE ``b_<tag>``: the series with idx, anchors and its three baselines."""
    _cte(f"i_{tag}", f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dy) AS idx FROM {series}", series)
    _cte(
        f"e_{tag}",
        f"""SELECT a.user_id, a.dy, a.idx, any_value(a.v) AS v,
            min(b.idx) FILTER (a.dy - b.dy BETWEEN 1 AND 6) AS wi,
            min(b.idx) FILTER (a.dy - b.dy BETWEEN 1 AND 29) AS mi,
            max(b.dy) FILTER (b.idx = a.idx - 1) AS prev_dy, max(b.v) FILTER (b.idx = a.idx - 1) AS prev_v
            FROM i_{tag} a JOIN i_{tag} b ON a.user_id = b.user_id AND b.idx <= a.idx
            GROUP BY a.user_id, a.dy, a.idx""",
        f"i_{tag}",
    )
    _cte(
        f"w_{tag}",
        f"SELECT *, nullif(CASE WHEN wi = idx - 1 THEN wi - 1 ELSE wi END, 0) AS week_idx FROM e_{tag}",
        f"e_{tag}",
    )
    _cte(
        f"a_{tag}",
        f"""SELECT *, CASE WHEN week_idx IS NOT NULL
            THEN nullif(CASE WHEN mi = week_idx THEN mi - 1 ELSE mi END, 0) END AS month_idx FROM w_{tag}""",
        f"w_{tag}",
    )
    # sums in day order, so that the last bit does not depend on the engine
    in_week = "b.idx BETWEEN a.week_idx AND a.idx - 1"
    in_month = (
        "a.month_idx IS NOT NULL AND b.idx BETWEEN least(a.week_idx, a.month_idx) AND greatest(a.week_idx, a.month_idx)"
    )

    def mean(condition: str) -> str:
        return f"""list_sum(list(CAST(b.v AS DOUBLE) ORDER BY b.idx) FILTER ({condition} AND b.v IS NOT NULL))
            / count(b.v) FILTER ({condition})"""

    _cte(
        f"b_{tag}",
        f"""SELECT a.user_id, a.dy, any_value(a.v) AS v, a.idx, any_value(a.week_idx) AS week_idx,
            any_value(a.month_idx) AS month_idx, any_value(CAST(a.prev_v AS DOUBLE)) AS prev_v,
            {mean(in_week)} AS week_v, {mean(in_month)} AS month_v
            FROM a_{tag} a JOIN i_{tag} b ON a.user_id = b.user_id AND b.idx <= a.idx
            GROUP BY a.user_id, a.dy, a.idx""",
        f"a_{tag}",
        f"i_{tag}",
    )


_SERIES = {
    "sessions_per_day": "s_sessions",
    "cmd_per_day": "s_commands",
    "good_cmd": "s_good",
    "bad_cmd": "s_bad",
    "five_cmd_match": "s_match",
    "sess_dur": "s_duration",
}
_LOW = ("good_cmd", "five_cmd_match")


def _flag(feature: str, v="v", prev="prev_v", week="week_v", month="month_v") -> str:
    op, factors = ("<", (0.5, 0.4, 0.3)) if feature in _LOW else (">", (1.5, 1.4, 1.3))
    d, w, m = (f"CAST({k} AS DOUBLE)" for k in factors)
    return f"""CAST(CASE WHEN ({prev} IS NULL OR {prev} = 0 OR {v} {op} {d} * {prev})
        AND {v} {op} {w} * {week} AND {v} {op} {m} * {month} THEN 1 ELSE 0 END AS BIGINT)"""


_OK = "(v IS NOT NULL AND week_v IS NOT NULL AND month_v IS NOT NULL)"

for _feature, _series in _SERIES.items():
    # every feature is compared over the days with a session, also those on which it has no value
    _cte(
        f"x_{_feature}",
        f"SELECT z.user_id, z.dy, t.v FROM s_sessions z LEFT JOIN {_series} t ON t.user_id = z.user_id AND t.dy = z.dy",
        *dict.fromkeys(("s_sessions", _series)),
    )
    _baseline(_feature, f"x_{_feature}")

# the as-coded variant: the first test day's baselines serve all test days, week = day before
for _feature in _SERIES:
    _cte(
        f"f_{_feature}",
        f"""SELECT t.user_id, t.dy, t.v, k.prev_v, CASE WHEN k.week_idx IS NOT NULL THEN k.prev_v END AS last_v,
            k.week_v, k.month_v, k.idx AS first_test
            FROM b_{_feature} t JOIN
            (SELECT user_id, min(idx) AS idx FROM b_{_feature} WHERE dy >= DATE '{TEST_FROM}' GROUP BY user_id) f
            ON t.user_id = f.user_id AND (t.idx = f.idx OR (t.idx > f.idx AND f.idx > 1))
            JOIN b_{_feature} k ON k.user_id = f.user_id AND k.idx = f.idx""",
        f"b_{_feature}",
    )


def _matrix(prefix: str, week: str) -> tuple[str, tuple[str, ...]]:
    """All six flags on the spine of days with a session."""
    names = list(_SERIES)
    columns = ", ".join(
        _flag(f, f"{f}.v", f"{f}.prev_v", f"{f}.{week}", f"{f}.month_v") + f" AS {f}" for f in names
    )
    complete = " AND ".join(
        f"{f}.v IS NOT NULL AND {f}.{week} IS NOT NULL AND {f}.month_v IS NOT NULL" for f in names
    )
    joins = "".join(
        f" LEFT JOIN {prefix}_{f} {f} ON {f}.user_id = z.user_id AND {f}.dy = z.dy" for f in names[1:]
    )
    spine = f"{prefix}_{names[0]}"
    sql = f"""SELECT z.user_id, {_day("z.dy")} AS day, {columns}, ({complete}) AS baseline_ok
        FROM {spine} z JOIN {spine} {names[0]} ON {names[0]}.user_id = z.user_id AND {names[0]}.dy = z.dy{joins}"""
    return sql, tuple(f"{prefix}_{f}" for f in names)


_CLEAN = r"""regexp_replace(regexp_replace(lower(text), '[0-9]+', '', 'g'), '[ \t\r\n\f\x0B]+', ' ', 'g')"""
_cte("tokens", f"SELECT doc_id, unnest(string_split({_CLEAN}, ' ')) AS term FROM documents")
_cte(
    "counted",
    "SELECT doc_id, term, count(*) AS n FROM tokens WHERE length(term) >= 3 GROUP BY ALL",
    "tokens",
)


# sessions and commands cut down to those inside an opt-in period
_OPTED_IN = {
    "sess": (
        ("placed", "periods"),
        f"SELECT s.* FROM placed s WHERE EXISTS (SELECT 1 FROM periods p WHERE {_INSIDE})",
    ),
    "cmds": (("all_cmds", "sess"), "SELECT * FROM all_cmds SEMI JOIN sess USING (session_id)"),
}


# commands of which whole sessions are missing
_SOME_SILENT = {"cmds": (("all_cmds",), f"SELECT * FROM all_cmds WHERE cmd_root NOT IN {SILENT}")}


def oracle_sql() -> dict[str, str]:
    d, dz = _day(), _day("z.dy")
    q: dict[str, str] = {}
    q["sessions_from_events"] = _with(
        f"""SELECT session_id, user_id, {_ts("start_ts")} AS start_ts, {_ts("last_ts")} AS last_ts, {d} AS day,
        stamp, server_id, commands_count, violations, triggered_total FROM sess""",
        "sess",
    )
    q["commands_from_events"] = _with(
        f"SELECT cmd_id, session_id, user_id, {_ts('ts')} AS ts, {d} AS day, cmd FROM cmds", "cmds"
    )
    q["tenant_scope_lookup"] = _with(
        """SELECT server_id, project_id FROM srv WHERE project_id IN (SELECT n_nationkey FROM nation
        WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')))""",
        "srv",
    )
    q["tenant_partition_filter"] = _with(
        """SELECT session_id, project_id, user_id FROM placed JOIN nation ON project_id = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'""",
        "placed",
    )
    q["server_count"] = "SELECT count(*) AS servers FROM supplier"
    q["csv_scan_roundtrip"] = _with("SELECT cmd, cmd_rep AS label FROM cmds", "cmds")
    q["csv_positional_read"] = _with(
        """SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(commands_count AS BIGINT) AS commands,
        CASE WHEN violations > 0 THEN CAST(violations AS BIGINT) END AS violations, stamp FROM sess""",
        "sess",
    )
    q["session_projection"] = _with(
        f"""SELECT session_id AS id, server_id, stamp AS date_created, {_ts("last_ts")} AS date_last_command,
        commands_count, violations, triggered_total - violations AS triggered_count, user_id AS auth_user_id,
        {_ts("start_ts")} AS time_created FROM sess""",
        "sess",
    )
    q["one_user_sessions"] = _with(
        f"""SELECT session_id, user_id, substring(stamp, 1, 8) AS day_stamp, {_ts("start_ts")} AS start_ts FROM sess
        WHERE user_id = (SELECT user_id FROM sess GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""",
        "sess",
    )
    q["commands_semi_join"] = _with(
        "SELECT cmd_id, session_id, cmd FROM cmds WHERE session_id IN (SELECT session_id FROM sess WHERE violations > 0)",
        "cmds",
        "sess",
    )
    q["train_test_split_by_date"] = _with(
        f"""SELECT user_id, {d} AS day, idx, k AS first_test, CASE WHEN k = 1 AND idx = 1 THEN 'test'
        WHEN k = 1 THEN NULL WHEN k IS NULL OR idx < k THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, min(CASE WHEN dy >= DATE '{TEST_FROM}' THEN idx END) OVER (PARTITION BY user_id) AS k
        FROM i_sessions_per_day)""",
        "i_sessions_per_day",
    )
    q["latest_days"] = _with(
        f"""SELECT user_id, {d} AS day, v AS sessions_per_day FROM s_sessions
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY dy DESC) <= 6""",
        "s_sessions",
    )
    q["union_with_origin"] = """SELECT doc_id, CASE quality WHEN 1 THEN 'GOOD' WHEN 0 THEN 'BAD' END AS label,
        CASE WHEN quality IS NULL THEN 'test' ELSE 'train' END AS origin FROM documents LEFT JOIN labels USING (doc_id)"""
    q["session_server_join"] = _with("SELECT session_id, server_id, project_id, hostname_ref FROM placed", "placed")
    q["session_project_join"] = _with(
        """SELECT session_id, server_id, project_id, CAST(n_regionkey AS BIGINT) AS company_id
        FROM placed JOIN nation ON project_id = n_nationkey""",
        "placed",
    )
    q["optin_interval_join"] = _with(
        f"""SELECT s.session_id, s.project_id, {_ts("s.start_ts")} AS start_ts, {_ts("p.start_date")} AS start_date,
        {_ts("p.end_date")} AS end_date FROM placed s JOIN periods p ON {_INSIDE}""",
        "placed",
        "periods",
    )
    q["optin_interval_semi"] = _with(
        f"""SELECT s.session_id, s.project_id, {_ts("s.start_ts")} AS start_ts FROM placed s
        WHERE EXISTS (SELECT 1 FROM periods p WHERE {_INSIDE})""",
        "placed",
        "periods",
    )
    q["geo_left_join"] = _with(
        f"""SELECT session_id, ip_id, country_name, ip_type,
        CASE WHEN latitude_text IS NOT NULL THEN {_id("latitude_text")} END AS latitude_ref FROM geo""",
        "geo",
    )
    q["session_server_join_dealt"], q["geo_left_join_dealt"] = q["session_server_join"], q["geo_left_join"]
    q["geo_dictionary_chain"] = _with(
        f"""SELECT session_id, country_name,
        (SELECT value FROM dict t WHERE t.project_id = g.project_id AND t.id = g.lat) AS latitude,
        (SELECT value FROM dict t WHERE t.project_id = g.project_id AND t.id = g.lon) AS longitude
        FROM (SELECT *, {_id("latitude_text")} AS lat, {_id("longitude_text")} AS lon FROM geo) g""",
        "geo",
        "dict",
    )
    q["dictionary_decode"] = _with(_SESSION_DECODE, "placed", "dict")
    q["dictionary_decode_unpivot"] = q["dictionary_decode"]
    q["command_dictionary_decode"] = _with(
        f"""SELECT cmd_id, session_id, project_id, {_role("c", "cmd_ref")} AS cmd, {_role("c", "cmd_root_ref")} AS cmd_root,
        {_role("c", "parameters_ref")} AS parameters,
        CASE WHEN root = 'click' THEN {_role("c", "parameters_ref")} END AS cwd,
        CASE WHEN root <> 'error' THEN {_role("c", "cmd_root_ref")} END AS exec_path,
        {_role("c", "cmd_ref")} AS binary_hash
        FROM (SELECT cmd_id, session_id, project_id, cmd_root AS root, {_id("cmd")} AS cmd_ref,
        {_id("cmd_root")} AS cmd_root_ref, {_id("parameters")} AS parameters_ref FROM pcmds) c""",
        "pcmds",
        "dict",
    )
    q["session_rows"] = _with(
        f"""SELECT s.session_id AS id, s.server_id, s.session_id % 32768 AS pid,
        coalesce({_role("s", "hostname_ref")}, '') AS hostname, coalesce({_role("s", "host_ip_ref")}, '') AS host_ip,
        {_role("s", "user_ref")} AS "user", c_name AS cmd_username, c_mktsegment AS cmd_fullname,
        coalesce({_role("s", "ip_ref")}, '') AS ip, s.stamp AS date_created,
        {_ts("s.last_ts")} AS date_disconnected, {_ts("s.start_ts")} AS first_time_seen,
        substring(s.country_name, 1, 2) AS country_code, s.ip_type,
        date_sub('second', s.start_ts, s.last_ts) AS session_duration, {_ts("s.last_ts")} AS date_last_command,
        s.commands_count, s.violations, s.country_name, 'R' || s.place % 4 AS region_code,
        'city ' || s.place % 7 AS city, lpad(CAST(s.place AS VARCHAR), 5, '0') AS postal_code,
        {_role("s", "lat")} AS latitude, {_role("s", "lon")} AS longitude,
        'continent ' || s.continent AS continent_code, 'region ' || s.place % 4 AS region_name,
        s.ip_id % 5 AS ip_risk_score, s.project_id, s.triggered_total - s.violations AS triggered_count,
        CASE WHEN s.session_id % 2 = 0 THEN 'ssh' ELSE 'console' END AS how_connected,
        coalesce({_role("s", "ports_ref")}, '') AS ports, '10.0.0.' || s.ip_id AS created_ip,
        coalesce({_role("s", "created_by_ref")}, '') AS created_by,
        CASE WHEN s.session_id % 3 = 0 THEN 0 ELSE 1 END AS interactive, s.user_id AS auth_user_id,
        'approver ' || s.user_id % 10 AS duo_approver, {_ts("s.start_ts")} AS time_created,
        CASE WHEN s.violations > 0 THEN {_ts("s.last_ts")} END AS stopped_by_user_date
        FROM (SELECT *, {_id("latitude_text")} AS lat, {_id("longitude_text")} AS lon FROM geo) s
        LEFT JOIN customer ON s.user_id = c_custkey WHERE EXISTS (SELECT 1 FROM periods p WHERE {_INSIDE})""",
        "geo",
        "dict",
        "periods",
    )
    q["command_rows"] = _with(
        f"""SELECT cmd_id AS id, CASE WHEN root IN ('click', 'view') THEN 'builtin' ELSE 'external' END AS command_type,
        strftime(ts, '%Y%m%d%H') AS date_created, CASE WHEN root = 'error' THEN 1 ELSE 0 END AS trigger_status,
        cmd_id % 2 AS user_typed, session_id, cmd_id AS server_cmd_id,
        CASE WHEN root = 'signup' THEN 'LANG=C' END AS extra_vars, cmd_id % 32768 AS pid,
        CASE WHEN cmd_id <> session_id THEN session_id END AS parent_server_cmd_id, cmd_id % 3 AS child_count,
        {_ts("ts")} AS time_created, CASE WHEN cmd_id = session_id THEN 1 ELSE 0 END AS is_parent,
        {_role("c", "cmd_ref")} AS cmd, {_role("c", "cmd_root_ref")} AS cmd_root,
        {_role("c", "parameters_ref")} AS parameters,
        CASE WHEN root = 'click' THEN {_role("c", "parameters_ref")} END AS cwd,
        CASE WHEN root <> 'error' THEN {_role("c", "cmd_root_ref")} END AS exec_path,
        {_role("c", "cmd_ref")} AS binary_hash
        FROM (SELECT cmd_id, session_id, project_id, ts, cmd_root AS root, {_id("cmd")} AS cmd_ref,
        {_id("cmd_root")} AS cmd_root_ref, {_id("parameters")} AS parameters_ref FROM pcmds) c
        WHERE session_id IN (SELECT s.session_id FROM placed s WHERE EXISTS (SELECT 1 FROM periods p WHERE {_INSIDE}))""",
        "pcmds",
        "dict",
        "placed",
        "periods",
    )
    q["session_user_left_join"] = _with(
        """SELECT session_id, user_id, c_name AS username, c_mktsegment AS full_name
        FROM sess LEFT JOIN customer ON user_id = c_custkey""",
        "sess",
    )
    q["tenant_key_decrypt"] = _with("SELECT project_id, id, value FROM dict", "dict")

    q["distinct_user_count"] = _with("SELECT count(DISTINCT user_id) AS users FROM sess", "sess")
    q["users_by_week_sketch"] = _with(
        """SELECT strftime(date_trunc('week', dy), '%Y-%m-%d') AS week, count(DISTINCT user_id) AS users, true AS near
        FROM sess GROUP BY ALL""",
        "sess",
    )
    q["sorted_sessions_per_day"] = _with(
        f"""SELECT user_id, {d} AS day, v AS sessions_per_day,
        row_number() OVER (ORDER BY dy, user_id NULLS FIRST) - 1 AS place FROM s_sessions""",
        "s_sessions",
    )
    q["distinct_users"] = _with("SELECT DISTINCT user_id FROM sess", "sess")
    q["distinct_sessions"] = _with("SELECT DISTINCT session_id FROM sess", "sess")
    q["observed_days"] = _with(f"SELECT DISTINCT user_id, {d} AS day FROM sess", "sess")
    q["observed_day_count"] = _with("SELECT user_id, count(DISTINCT dy) AS days FROM sess GROUP BY user_id", "sess")
    q["sessions_per_day"] = _with(f"SELECT user_id, {d} AS day, v AS sessions_per_day FROM s_sessions", "s_sessions")
    q["commands_per_session"] = _with("SELECT * FROM per_sess", "per_sess")
    q["commands_per_session_day"] = _with(
        f"SELECT session_id, user_id, {d} AS day, cmds FROM sess JOIN per_sess USING (session_id)", "sess", "per_sess"
    )
    q["mean_commands_per_day"] = _with(
        f"SELECT user_id, {d} AS day, round(v, 6) AS cmd_per_day FROM s_commands", "s_commands"
    )
    q["session_duration"] = _with("SELECT session_id, seconds FROM dur", "dur")
    q["session_duration_by_day"] = _with(f"SELECT session_id, user_id, {d} AS day, seconds FROM dur", "dur")
    q["mean_duration_per_day"] = _with(
        f"SELECT user_id, {d} AS day, round(v, 6) AS sess_dur FROM s_duration", "s_duration"
    )
    q["reputation_per_session"] = _with("SELECT * FROM rep", "rep")
    q["reputation_means_per_day"] = _with(
        f"""SELECT user_id, {d} AS day, round(mean_total, 6) AS mean_total, round(mean_good, 6) AS mean_good,
        round(mean_bad, 6) AS mean_bad FROM rep_day""",
        "rep_day",
    )
    q["reputation_share_per_day"] = _with(
        f"""SELECT user_id, {d} AS day, round(mean_good / mean_total, 6) AS good_cmd,
        round(mean_bad / mean_total, 6) AS bad_cmd FROM rep_day""",
        "rep_day",
    )
    q["daily_features"] = _with(
        f"""SELECT z.user_id, {dz} AS day, z.v AS sessions_per_day, round(c.v, 6) AS cmd_per_day,
        round(t.v, 6) AS sess_dur, round(g.v, 6) AS good_cmd, round(b.v, 6) AS bad_cmd
        FROM s_sessions z LEFT JOIN s_commands c USING (user_id, dy) LEFT JOIN s_duration t USING (user_id, dy)
        LEFT JOIN s_good g USING (user_id, dy) LEFT JOIN s_bad b USING (user_id, dy)""",
        "s_sessions", "s_commands", "s_duration", "s_good", "s_bad",
    )
    q["session_command_list"] = _with(
        """SELECT session_id, CAST(0 AS BIGINT) AS chunk_no, string_agg(lower(cmd), ' ' ORDER BY ts, cmd_id) AS text
        FROM cmds GROUP BY session_id""",
        "cmds",
    )
    q["day_command_text"] = _with(
        f"SELECT user_id, {d} AS day, CAST(0 AS BIGINT) AS chunk_no, txt AS text FROM texts", "texts"
    )
    q["day_command_chunks"] = _with(
        f"""SELECT user_id, {d} AS day, no AS chunk_no, substr(txt, no * {SMALL_CHUNK} + 1, {SMALL_CHUNK}) AS text
        FROM (SELECT *, unnest(range(CAST(ceil(length(txt) / {SMALL_CHUNK}.0) AS BIGINT))) AS no FROM texts)""",
        "texts",
    )
    q["day_similarity"] = _with(f"SELECT user_id, {d} AS day, round(v, 6) AS five_cmd_match FROM s_match", "s_match")
    q["day_similarity_blocks"] = q["day_similarity"]
    q["day_similarity_first_session"] = _with(
        f"SELECT user_id, {d} AS day, round(v, 6) AS five_cmd_match FROM s_match_first", "s_match_first"
    )

    base = "b_sessions_per_day"
    q["day_index"] = _with(
        f"SELECT user_id, {d} AS day, v AS sessions_per_day, idx FROM i_sessions_per_day", "i_sessions_per_day"
    )
    q["baseline_anchors"] = _with(
        f"""SELECT user_id, {d} AS day, idx, {_day("prev_dy")} AS prev_day, week_idx, month_idx,
        CAST(dy - prev_dy AS BIGINT) AS gap_days FROM a_sessions_per_day""",
        "a_sessions_per_day",
    )
    q["baseline_prev_day"] = _with(f"SELECT user_id, {d} AS day, prev_v AS prev_value FROM {base}", base)
    q["baseline_week"] = _with(f"SELECT user_id, {d} AS day, round(week_v, 6) AS week_value FROM {base}", base)
    q["baseline_week_last"] = _with(
        f"SELECT user_id, {d} AS day, CASE WHEN week_idx IS NOT NULL THEN prev_v END AS week_value FROM {base}", base
    )
    q["baseline_month"] = _with(f"SELECT user_id, {d} AS day, round(month_v, 6) AS month_value FROM {base}", base)
    q["baseline_rolling"] = _with(
        f"""SELECT user_id, {d} AS day, v AS sessions_per_day, idx, week_idx, month_idx, prev_v AS prev_value,
        round(week_v, 6) AS week_value, round(month_v, 6) AS month_value, {_OK} AS baseline_ok FROM {base}""",
        base,
    )
    q["baseline_frozen"] = _with(
        f"""SELECT user_id, {d} AS day, prev_v AS prev_value, round(week_v, 6) AS week_value,
        round(month_v, 6) AS month_value FROM f_sessions_per_day""",
        "f_sessions_per_day",
    )

    single = {
        "flag_sessions": "sessions_per_day",
        "flag_commands": "cmd_per_day",
        "flag_duration": "sess_dur",
        "flag_good": "good_cmd",
        "flag_bad": "bad_cmd",
        "flag_match": "five_cmd_match",
    }
    for name, f in single.items():
        value = "v" if f == "sessions_per_day" else "round(v, 6)"
        q[name] = _with(
            f"SELECT user_id, {d} AS day, {value} AS feature_value, {_flag(f)} AS flag, {_OK} AS baseline_ok FROM b_{f}",
            f"b_{f}",
        )
    for name in ("flag_commands", "flag_bad"):
        f = single[name]
        q[f"{name}_silent_sessions"] = _with(
            f"SELECT user_id, {d} AS day, round(v, 6) AS feature_value, {_flag(f)} AS flag, {_OK} AS baseline_ok FROM b_{f}",
            f"b_{f}",
            replaced=_SOME_SILENT,
        )
    q["flag_no_prev_day"] = _with(
        f"""SELECT user_id, {d} AS day, round(prev_v, 6) AS prev_value, (prev_v IS NULL OR prev_v = 0) AS week_and_month_only,
        {_flag("sess_dur")} AS flag FROM b_sess_dur""",
        "b_sess_dur",
    )
    sql, needs = _matrix("b", "week_v")
    q["flag_matrix"] = _with(sql, *needs)
    q["flag_matrix_modelled"] = q["flag_matrix"]
    q["flags_incremental"] = q["flag_matrix"]
    q["day_verdict_from_csv"] = _with(
        f"""SELECT user_id, day, CASE WHEN bad_cmd = 1 THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction FROM ({sql})""", *needs
    )
    q["flag_matrix_silent_sessions"] = _with(sql, *needs, replaced=_SOME_SILENT)
    q["flag_matrix_opted_in"] = _with(sql, *needs, replaced=_OPTED_IN)
    sql, needs = _matrix("f", "last_v")
    q["flag_matrix_frozen"] = _with(sql, *needs)

    q["day_from_stamp"] = _with(
        f"SELECT session_id, substring(stamp, 1, 8) AS day_stamp, {d} AS day FROM sess", "sess"
    )
    q["parse_session_start"] = _with(
        f"""SELECT session_id, {_ts("date_trunc('second', start_ts)")} AS start_second,
        {_ts("date_trunc('minute', start_ts)")} AS start_minute FROM sess""",
        "sess",
    )
    q["clean_text"] = f"SELECT doc_id, {_CLEAN} AS text FROM documents"
    q["trim_commas"] = "SELECT event_id AS cmd_id, event_type || ' ' || props || ',x' AS trimmed FROM events"

    q["term_counts"] = _with("SELECT * FROM counted", "counted")
    q["term_moments"] = _with(
        """SELECT term, round(s1 / texts, 6) AS mean, round(sqrt((texts * s2 - s1 * s1) / (texts * (texts - 1))), 6) AS sd
        FROM (SELECT term, CAST(sum(n) AS DOUBLE) AS s1, CAST(sum(n * n) AS DOUBLE) AS s2 FROM counted GROUP BY term),
        (SELECT CAST(count(*) AS DOUBLE) AS texts FROM documents)""",
        "counted",
    )
    q["standardised_terms"] = _with(
        """SELECT doc_id, term, round((n - s1 / texts) / sd, 6) AS z FROM counted JOIN
        (SELECT *, sqrt((texts * s2 - s1 * s1) / (texts * (texts - 1))) AS sd FROM
        (SELECT term, CAST(sum(n) AS DOUBLE) AS s1, CAST(sum(n * n) AS DOUBLE) AS s2 FROM counted GROUP BY term),
        (SELECT CAST(count(*) AS DOUBLE) AS texts FROM documents)) m USING (term) WHERE sd > 0""",
        "counted",
    )
    q["dtm_sparse"] = _with(
        """SELECT doc_id, list(number ORDER BY number) AS numbers, list(n ORDER BY number) AS counts
        FROM counted JOIN (SELECT term, row_number() OVER (ORDER BY term) - 1 AS number
          FROM (SELECT DISTINCT term FROM counted)) USING (term) GROUP BY doc_id""",
        "counted",
    )
    q["component_residuals"] = "SELECT range AS component, true AS solved FROM range(60)"
    q["component_correlations"] = f"""SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r
        FROM range({COMPONENTS}) a(i), range({COMPONENTS}) b(j)"""
    q["command_reputation_from_csv"] = _with("SELECT cmd_id, cmd_rep, true AS sure FROM cmds", "cmds")
    q["reputation_holdout"] = _with(
        f"""SELECT cmd_rep AS label, cmd_rep AS prediction, count(*) AS n FROM cmds
        WHERE dy < DATE '{TEST_FROM}' AND substring(md5(cmd), 1, 4) < '5555' GROUP BY ALL""",
        "cmds",
    )
    q["command_reputation_join"] = _with("SELECT cmd_id, session_id, cmd_rep FROM cmds", "cmds")
    pairs = """SELECT CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS label,
        CASE WHEN toxic = 1 THEN 'BAD' ELSE 'GOOD' END AS prediction FROM labels"""
    q["confusion_matrix"] = f"SELECT label, prediction, count(*) AS n FROM ({pairs}) GROUP BY ALL"
    q["accuracy"] = (
        f"SELECT round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM ({pairs})"
    )
    q["stream_sessions_per_day"] = _with(
        f"""SELECT user_id, {d} AS day, count(*) AS sessions_per_day FROM sess
        WHERE last_ts + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND <=
        (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY ALL""",
        "sess",
    )
    return q
