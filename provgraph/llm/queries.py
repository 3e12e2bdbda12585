"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, line_dedup, mixing, quality, sharding, simhash, token_counts, toxicity, warc
from .common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, packed and read back: a row per conv_id.

    Turns go by (turn, role, text), nulls first; null roles and texts are empty, repeated rows are
    turns of their own, rows without a conv_id are one conversation, long texts have the tokens of
    the whole text. Without rows only the probe comes. Other columns are not looked at.
    """
    return chat.conversation_report(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``: lines, dropped lines, hash of what stays.

    Null and empty texts are one empty line. Repeated rows of an id share its lines' fate; a null
    id is below all others. Of equal lines in the document with the largest id all stay. An empty
    table gives an empty table. Other columns are not looked at.
    """
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``: statistics, base rules, and the verdict of the line frequencies.

    Null and empty texts have no words and fail; a null host is a host; rows of one id are one
    document, rows without an id count once per text; a line exactly at the limit stays. Texts are
    read whole. An empty table gives an empty table. Other columns are not looked at.
    """
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``pages``, read back from the archives.

    Null html is an empty payload; of equal payloads the rows with the largest page_id, repeated
    ones too, are responses, and a null page_id is below all others. Payloads are kept whole. An
    empty table writes no archive and gives an empty table. Other columns are not looked at.
    """
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents`` under the law ``bytes``.

    Null text counts as empty and is in the group of empty texts; repeated rows have slots of their
    own; ties of size go by group key, ties of slot by id and key. An empty table gives an empty
    table. Other columns are not looked at.
    """
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per row of ``documents``, learned from ``labels`` outside the held-out fold.

    Null and empty texts get the score of a text without a hit; repeated rows equal scores; of
    several labels of an id the highest counts, null ids and labels none; with labels of one class
    or none every score is their smoothed share. An empty table gives an empty table. Other columns
    are not looked at.
    """
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per row of ``documents``, counted in token files by their separators.

    Null and empty texts have none; repeated rows and rows without an id are documents of their
    own; long texts have the tokens of the whole text. An empty table writes no file and gives an
    empty table. Other columns are not looked at.
    """
    return token_counts.token_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component per row of ``documents``.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows get equal
    answers; a null id names a component only if all its ids are null. An empty table gives an
    empty table. Other columns are not looked at.
    """
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items per row of ``documents``.

    Null and empty texts have no words; items without a word have no window; a null item_id marks
    words but is in no list; repeated rows and items count once each, and every row gets its answer.
    Without items nothing is hit; an empty table gives an empty table. Other columns are not looked at.
    """
    return decontam.decontam_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each row of ``documents``.

    Null text has size 0; a null source is a source, last in order; rows equal in id and text are
    taken alike; a source at its cap takes each row exactly twice, rows without words among them. An
    empty table gives an empty table. Other columns are not looked at.
    """
    return mixing.mix_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat, op2_line_dedup, op3_quality, op4_warc, op5_sharding, op6_toxicity, op7_token_counts, op8_simhash, op9_decontamination, op10_mixing)}
SQL = {"op1_chat": chat.CHAT_SQL, "op2_line_dedup": line_dedup.LINE_DEDUP_SQL, "op3_quality": quality.QUALITY_SQL, "op4_warc": warc.WARC_SQL, "op9_decontamination": decontam.DECONTAM_SQL, "op10_mixing": mixing.MIX_SQL}
