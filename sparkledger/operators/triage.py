"""Risk triage of log texts: keyword rules, scored replies, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RISKS

#: Keyword rules by priority: words (any of them), risk, operation type, intervention, suggestion.
ATTACKS = (
    (("SQL INJECTION", "UNION SELECT", "' OR '1'='1", "DROP TABLE"), "CRITICAL", "检测到 SQL 注入攻击特征，立即封禁源 IP 并排查数据库日志"),
    (("XSS", "<SCRIPT>", "JAVASCRIPT:"), "CRITICAL", "检测到 XSS 攻击特征，检查 WAF 规则并审计相关页面"),
    (("PATH TRAVERSAL", "../", "..\\"), "HIGH", "检测到路径遍历攻击，检查文件访问权限配置"),
)
REFUSED = ("DENIED", "UNAUTHORIZED")
RULE_SUGGESTION, RULE_SUMMARY = "AI 返回格式异常，已使用降级规则分析，建议人工复核", "日志分析完成（降级模式）"
REPLY_SUGGESTION, REPLY_SUMMARY = "无需特殊处理", "日志分析完成"
NO_KEY, API_FAILURE = "rule-engine (fallback)", "rule-engine (api-failure fallback)"

REPLY = "operationType string, riskLevel string, needIntervention string, suggestion string, summary string, sourceIp string"
PROMPT = "You assess the security risk of a log text. Answer with one JSON object and nothing else: operationType, riskLevel (NORMAL, LOW, MEDIUM, HIGH or CRITICAL), needIntervention (true or false), suggestion, summary, sourceIp (or null)."


def _any(upper: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(upper, F.lit(w))
    return out


def _verdict(operation: str, risk: str, act: bool, suggestion: str = RULE_SUGGESTION) -> Column:
    return F.struct(F.lit(operation).alias("operation_type"), F.lit(risk).alias("risk_level"), F.lit(act).alias("need_intervention"), F.lit(suggestion).alias("suggestion"), F.lit(RULE_SUMMARY).alias("summary"), F.lit(None).cast("string").alias("source_ip"))


def rules(text: Column) -> Column:
    """The verdict of the keyword rules; the first that applies wins."""
    upper = F.upper(text)
    chain = F
    for words, risk, suggestion in ATTACKS:
        chain = chain.when(_any(upper, words), _verdict("ATTACK", risk, True, suggestion))
    chain = chain.when(_any(upper, REFUSED), _verdict("ACCESS", "MEDIUM", False))
    chain = chain.when(F.contains(upper, F.lit("FAIL")) & F.contains(upper, F.lit("LOGIN")), _verdict("LOGIN", "LOW", False))
    return chain.otherwise(_verdict("UNKNOWN", "NORMAL", False))


def json_block(text: Column) -> Column:
    """From the first brace to the last, unless the text begins with one."""
    t = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when(t.startswith("{"), t).otherwise(F.coalesce(F.regexp_substr(t, F.lit(r"(?s)\{.*\}")), t))


def _reply(text: Column, j: Column, o: Column) -> Column:
    """The verdict, and whether it was parsed. j: the JSON block of the text, o: what it holds."""
    valid = F.coalesce(j.startswith("{") & j.endswith("}") & F.try_parse_json(j).isNotNull(), F.lit(False))
    verdict = F.struct(
        F.coalesce(o["operationType"], F.lit("UNKNOWN")).alias("operation_type"), F.coalesce(o["riskLevel"], F.lit("NORMAL")).alias("risk_level"),
        F.coalesce(F.lower(o["needIntervention"]).isin("true", "1"), F.lit(False)).alias("need_intervention"),
        F.coalesce(o["suggestion"], F.lit(REPLY_SUGGESTION)).alias("suggestion"), F.coalesce(o["summary"], F.lit(REPLY_SUMMARY)).alias("summary"), o["sourceIp"].alias("source_ip"),
    )
    return F.struct(F.when(valid, verdict).otherwise(rules(text)).alias("verdict"), valid.alias("parsed"))


def parse_reply(text: Column) -> Column:
    """A verdict from a reply, with `parsed`; what is no JSON object goes through the rules. Taking several fields of it computes it as often: see with_reply."""
    j = json_block(text)
    return _reply(text, j, F.from_json(j, REPLY))


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once a row, however many columns are made from it: the optimizer doesn't merge projections across explode()."""
    return rows.withColumn(name, F.explode(F.array(value)))


def with_reply(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """The rows and parse_reply(text) under a name, each step computed once."""
    rows = held(held(rows, "__t", text), "__j", json_block(F.col("__t")))
    rows = held(rows, "__o", F.from_json("__j", REPLY))
    return held(rows, name, _reply(F.col("__t"), F.col("__j"), F.col("__o"))).drop("__t", "__j", "__o")


def envelope_text(body: Column) -> Column:
    """The text inside either wire format, else the body itself."""
    return F.coalesce(F.get_json_object(body, "$.content[0].text"), F.get_json_object(body, "$.choices[0].message.content"), body)


def request_payload(text: Column, url: str, model: str, prompt: str = PROMPT, max_tokens: int = 1024, temperature: float = 0.3) -> Column:
    """The request body for an offline scorer, in the format that the address asks for."""
    head = [F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens")]
    if "anthropic" in url:
        content = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
        return F.to_json(F.struct(*head, F.lit(prompt).alias("system"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages")))
    messages = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(prompt)), ("user", text))])
    return F.to_json(F.struct(*head, F.lit(temperature).alias("temperature"), messages.alias("messages")))


def resolve(logs: DataFrame, replies: DataFrame | None, model: str, id: str = "log_id", text: str = "log_content") -> DataFrame:
    """All columns of logs, then the verdict's, model_used, fallback and parse_fallback.

    replies: log_id, status, body; None where no scorer is configured. A status other than 200, or no reply, leaves the rules."""
    if replies is None:
        rows = held(logs, "__v", rules(F.col(text)))
        used, fallback, unparsed = F.lit(NO_KEY), F.lit(True), F.lit(False)
    else:
        rows = logs.join(replies.select(F.col("log_id").alias(id), F.col("status").alias("__s"), F.col("body").alias("__b")), id, "left")
        answered = F.coalesce((F.col("__s") == 200) & F.col("__b").isNotNull(), F.lit(False))
        rows = with_reply(rows.withColumn("__a", answered), "__r", F.when(F.col("__a"), envelope_text(F.col("__b"))))
        rows = held(rows, "__v", F.when(F.col("__a"), F.col("__r.verdict")).otherwise(rules(F.col(text))))
        used, fallback = F.when(F.col("__a"), F.lit(model)).otherwise(API_FAILURE), ~F.col("__a")
        unparsed = F.col("__a") & ~F.col("__r.parsed")
    keep = logs.columns
    return rows.select(*keep, "__v.*", used.alias("model_used"), fallback.alias("fallback"), unparsed.alias("parse_fallback"))


def floors(resolved: DataFrame, text: str = "log_content") -> DataFrame:
    """Risk raised to HIGH for signs of attack and to MEDIUM for refusals, never lowered."""
    order = F.array(*map(F.lit, RISKS))
    upper = F.upper(F.col(text))
    least = F.when(_any(upper, [w for words, *_ in ATTACKS for w in words]), 4).when(_any(upper, REFUSED), 3).otherwise(1)
    return resolved.withColumn("risk_level", F.element_at(order, F.greatest(F.array_position(order, F.col("risk_level")).cast("int"), least.cast("int"), F.lit(1))))


def history(resolved: DataFrame, id: str = "log_id", text: str = "log_content") -> DataFrame:
    """Rows of the history table, without an id where the input has none."""
    has = lambda c, kind: F.col(c) if c in resolved.columns else F.lit(None).cast(kind)
    return resolved.select(
        F.col(id).alias("id"), has("username", "string").alias("username"), F.col(text).alias("log_content"), F.col("summary").alias("log_summary"), "operation_type", "risk_level", "need_intervention",
        F.col("suggestion").alias("ai_suggestion"), "source_ip", "model_used", has("analysis_time_ms", "int").alias("analysis_time_ms"), F.coalesce(has("created_at", "timestamp_ntz"), F.current_timestamp().cast("timestamp_ntz")).alias("created_at"),
    )


def recent(rows: DataFrame, n: int = 20, username: str | None = None) -> DataFrame:
    """The newest, at most 100."""
    if username is not None:
        rows = rows.filter(F.col("username") == username)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(n, 0), 100))


def lookup(rows: DataFrame, id: int, username: str | None = None) -> DataFrame:
    """By id; with a user, other users' rows are as absent."""
    found = rows.filter(F.col("id") == id)
    return found if username is None else found.filter(F.col("username") == username)


def count(rows: DataFrame, username: str | None = None) -> DataFrame:
    return (rows if username is None else rows.filter(F.col("username") == username)).agg(F.count("*").alias("total"))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Deletion of a set of ids: the rows that stay, to be written elsewhere and swapped in."""
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def admissible(rows: DataFrame, text: str, least: int = 5, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Texts that are not blank and of 5 to 5000 characters, and the others."""
    ok = F.coalesce((F.regexp_replace(F.col(text), r"^[\x00-\x20]+|[\x00-\x20]+$", "") != "") & F.length(text).between(least, most), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)
