"""Queries of the training-data operators, and their SQL oracles."""

from __future__ import annotations

from . import ann, chat, fingerprints, mixing, near_dedup, personal_data, pieces, secret_scan, suffix_dedup, toxicity
from .common import table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op2_permutation_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_personal_data(spark, sf_dir):
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def chat_conversations(spark, sf_dir):
    """Whole conversations in reply order, of messages made to quote each other: the table's own quote nothing."""
    return chat.conversation_digests(table(spark, sf_dir, "conversations"))


def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op9_simhash_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


_QUERIES = (op1_suffix_dedup, op2_permutation_ann, op3_personal_data, op4_sentencepiece, op5_mix, op6_simhash_near_dedup, op7_chat_formatting, op8_secret_scan, op9_simhash_fingerprints, op10_toxicity, chat_conversations)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {"op5_mix": mixing.ORACLE, "op7_chat_formatting": chat.ORACLE, "chat_conversations": chat.CONVERSATIONS_ORACLE}
