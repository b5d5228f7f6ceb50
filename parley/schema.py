"""Column types of the tables the operators exchange."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS, _B = T.TimestampType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


USER = _struct(("id", _S), ("displayName", _S), ("phoneNumber", _S), ("email", _S), ("homeTown", _S))
PROPERTIES = T.MapType(_S, T.ArrayType(_S))
CONTEXT = _struct(("contextType", _S), ("environmentType", _S), ("domain", _S), ("environment", PROPERTIES))

CONVERSATION = _struct(
    ("conv_id", _S), ("owner", _S), ("user", USER), ("status", _S), ("properties", PROPERTIES),
    ("context", CONTEXT), ("last_modified", _TS), ("deleted", _TS))

MESSAGE = _struct(
    ("conv_id", _S), ("idx", _I), ("msg_id", _S), ("time", _TS), ("origin", _S), ("content", _S),
    ("user_id", _S), ("user_name", _S), ("private", _B), ("votes", _I), ("metadata", T.MapType(_S, _S)))

SPAN = _struct(
    ("conv_id", _S), ("msg_idx", _I), ("kind", _S), ("start", _I), ("end", _I), ("text", _S), ("pos", _S),
    ("phrase", _S), ("ner_type", _S), ("ner_tag", _S), ("prob", _D), ("lemma", _S), ("negated", _B),
    ("stopword", _B))

TOKEN = _struct(
    ("conv_id", _S), ("message_idx", _I), ("start", _I), ("end", _I), ("origin", _S), ("state", _S),
    ("value", _S), ("type", _S), ("hints", T.ArrayType(_S)), ("confidence", _D))

SLOT = _struct(
    ("conv_id", _S), ("template_idx", _I), ("template_type", _S), ("role", _S), ("token_type", _S),
    ("required", _B), ("token_idx", _L))

QUERY = _struct(
    ("conv_id", _S), ("template_idx", _I), ("creator", _S), ("title", _S), ("confidence", _D), ("url", _S),
    ("state", _S), ("params", T.ArrayType(_S)))

CHAT_EVENT = _struct(
    ("message_id", _S), ("channel_id", _S), ("channel_name", _S), ("user_id", _S), ("user_name", _S),
    ("text", _S), ("token", _S), ("webhook_url", _S), ("trigger_word", _S), ("origin", _S), ("timestamp", _L),
    ("support_area", _S), ("bot", _struct(("identifier", _S))))

# One conversation as exchanged in JSON files: messages nested, property values scalar or list.
CONVERSATION_JSON = _struct(
    ("id", _S), ("owner", _S),
    ("meta", _struct(("status", _S), ("properties", PROPERTIES), ("channel_id", T.ArrayType(_S)))),
    ("user", USER), ("context", CONTEXT), ("lastModified", _TS), ("deleted", _TS),
    ("messages", T.ArrayType(_struct(
        ("id", _S), ("time", _TS), ("origin", _S), ("content", _S), ("user", USER), ("private", _B),
        ("votes", _I), ("metadata", T.MapType(_S, _S))))))

# Token types in their defined order (the order is part of the token sort).
TOKEN_TYPES = ["Date", "Topic", "Entity", "Place", "Organization", "Person", "Product", "Attribute", "Term",
               "Keyword", "Other"]
GRAINS = ["millisecond", "second", "minute", "hour", "day", "week", "month", "year"]
STATUSES = ["New", "Ongoing", "Complete", "Deleted"]
ORIGINS = ["User", "Agent", "Bot"]
