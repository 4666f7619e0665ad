"""Schemas of the archive's tables.  Places compare null-safely; a null half is unknown."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def of(fields: str) -> T.StructType:
    """A schema from ``name type, ...``; needs no session, unlike parsing DDL."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


STORE = of("store_id string, content binary, stored_bytes long, codec string, path string, modified timestamp")
OBSERVATION = of("log_hash string, mailbox string, folder string, log_date string, store_id string, line_no int")
LOG_FILE = of("hash string, version int, mailbox string, folder string, date string, declared long, prev string, readable boolean, intact boolean, path string")
HEAD = of("mailbox string, folder string, last_run string, resume string, log string")
LISTING = of("mailbox string, folder string, ord long, msg_id string, message_id string, date string")
MESSAGE = of("store_id string, email_id string, date string, subject string")
ADDRESS = of("store_id string, address string")
LOCATION = of("store_id string, mailbox string, folder string")
#: The first line of a log file, and the lines after it.
LOG_HEADER = of("version int, mailbox string, folder string, date string, messages long, prev string")
LOG_LINE = of("store_id string")
HEAD_JSON = of("version int, job string, folder string, last_run string, log string")
HEADERS = of("email_id string, date string, subject string, senders strings, recipients strings")
