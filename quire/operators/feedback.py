"""Teacher feedback: a small command language over integration decisions, run in message order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CJK, contains_any, strip

#: The commands' words, in the order in which they are tried, and their replies.
COMMANDS = (("explain", ("为什么",)), ("keep", ("保留", "不要删除", "恢复")), ("remove", ("删除", "移除", "去掉")), ("split", ("分开", "拆分", "不是同一个", "不应该合并")), ("merge", ("合并", "归并")))
STOP = "为什么 我觉得 不应该 请保留 保留 删除 拆分 合并 不是 同一个 知识点 教材 系统".split()
NO_DECISIONS = "我还没有整合决策。请先运行“跨教材整合”，再告诉我需要保留、删除、合并或拆分哪个知识点。"
MERGE = "可以合并。请用“合并 A 和 B”的格式告诉我两个知识点；当前版本会把它记录为教师建议，下一次整合会优先考虑。"
HELP = "我理解你的反馈。当前可执行命令包括：为什么合并/删除 X、保留 X、删除 X、拆分 X。你的对话历史会保留在当前会话中。"
UNKNOWN = "我没有找到对应的整合决策。可以提供更具体的知识点名称，例如“为什么合并 动作电位”。"
NOTES = {"keep": "；教师反馈要求保留“%s”，系统已锁定为 keep。", "remove": "；教师反馈要求删除“%s”，系统已调整为 remove。", "split": "；教师反馈认为“%s”不应合并，系统已将该决策改为 split，前端会显示为待拆分。"}
DONE = {"keep": "已根据教师反馈保留“%s”，对应决策已锁定并会在图谱中保留。", "remove": "已把“%s”标记为删除。", "split": "已把“%s”相关合并决策改为拆分。"}
MISSED = {"keep": "没找到“%s”对应决策，请换一个更精确名称。", "remove": "没找到“%s”对应决策，请换一个更精确名称。", "split": "没有找到包含“%s”的合并决策。"}


def command(message: Column) -> Column:
    """The first command whose words the message has; help if none."""
    out = None
    for name, words in COMMANDS:
        out = (F if out is None else out).when(contains_any(message, words), name)
    return out.otherwise("help")


def keyword(message: Column) -> Column:
    """The last run of 2 to 20 name characters that is no command word or number; else the last 12 characters."""
    found = F.filter(F.regexp_extract_all(message, F.lit(f"[{CJK}A-Za-z0-9_\\-]{{2,20}}"), F.lit(0)), lambda x: ~x.isin(STOP) & ~x.rlike("(?U)^\\d+$"))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.substring(message, F.greatest(F.lit(1), F.length(message) - 11), F.lit(12)))


def parsed(commands: DataFrame) -> DataFrame:
    """(seq, message, command, keyword)."""
    text = strip(F.col("message"))
    return commands.select("seq", text.alias("message"), command(text).alias("command"), keyword(text).alias("keyword"))


def with_names(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """decisions with __text: the names, aliases and definitions of their nodes that the integrated graph has, as an array."""
    named = nodes.select(F.col("id").alias("nid"), F.array("name", F.array_join("aliases", ""), F.coalesce("definition", F.lit(""))).alias("t"))
    ids = decisions.select("decision_ord", F.explode(F.array_distinct(F.concat("affected_nodes", F.filter(F.array("result_node"), lambda x: x.isNotNull())))).alias("nid"))
    texts = ids.join(named, "nid").groupBy("decision_ord").agg(F.flatten(F.collect_list("t")).alias("__text"))
    return decisions.join(texts, "decision_ord", "left").withColumn("__text", F.coalesce("__text", F.array().cast("array<string>")))


def decision_matches(word: str) -> Column:
    if not word:
        return F.lit(False)
    has = lambda c: F.contains(c, F.lit(word))
    return has(F.col("reason")) | F.exists("affected_nodes", has) | F.exists("__text", has)


def apply(decisions: DataFrame, nodes: DataFrame, action: str, word: str) -> DataFrame:
    """All decisions after one command; changed tells those that it touched."""
    rows = with_names(decisions, nodes)
    hit = decision_matches(word) & ((F.col("action") == "merge") if action == "split" else F.lit(action in NOTES))
    rows = rows.withColumn("changed", hit)
    note = F.lit(NOTES.get(action, "%s") % word)
    return (
        rows.withColumn("reason", F.when(F.col("changed"), F.concat("reason", note)).otherwise(F.col("reason")))
        .withColumn("action", F.when(F.col("changed"), F.lit(action)).otherwise(F.col("action")))
        .withColumn("teacher_locked", F.col("changed") | F.col("teacher_locked"))
        .drop("__text")
    )


def handle(decisions: DataFrame, nodes: DataFrame, message: str) -> tuple[str, DataFrame | None]:
    """(reply, all decisions after the message, or None if nothing changed)."""
    spark = decisions.sparkSession
    if not decisions.limit(1).count():
        return NO_DECISIONS, None
    row = parsed(spark.createDataFrame([(1, message)], "seq long, message string")).first()
    if row.command == "explain":
        first = with_names(decisions, nodes).where(decision_matches(row.keyword)).orderBy("decision_ord").select("reason", "confidence").first()
        if not first:
            return UNKNOWN, None
        return f"关于“{row.keyword}”：{first.reason} 置信度 {first.confidence:.2f}。如果你认为不合理，可以说“保留 {row.keyword}”或“拆分 {row.keyword}”。", None
    if row.command not in NOTES:
        return (MERGE if row.command == "merge" else HELP), None
    after = apply(decisions, nodes, row.command, row.keyword)
    if not after.where("changed").limit(1).count():
        return MISSED[row.command] % row.keyword, None
    return DONE[row.command] % row.keyword, after.drop("changed")


def run_all(decisions: DataFrame, nodes: DataFrame, messages: list[str]) -> tuple[list[str], DataFrame]:
    """Replies and the decisions after all messages, in order: a later command sees what earlier ones wrote."""
    replies = []
    for m in messages:
        reply, after = handle(decisions, nodes, m)
        replies.append(reply)
        decisions = decisions if after is None else after
    return replies, decisions
