"""Schemas of the records that the engine reads and writes, as Spark DDL."""

MESSAGE = "id BIGINT, date TIMESTAMP, text STRING, url STRING, contact_links ARRAY<STRING>, views BIGINT, forwards BIGINT, channel STRING"
#: Marked parts of a text: offset and length in characters (code points) of the text without white space at its ends.
ENTITIES = "ARRAY<STRUCT<type: STRING, offset: INT, length: INT, url: STRING>>"
MESSAGE_WITH_ENTITIES = f"{MESSAGE}, entities {ENTITIES}"
RAW_JOB = "title STRING, company STRING, description STRING, salary STRING, location STRING, source STRING, url STRING, posted_at TIMESTAMP, contact_links ARRAY<STRING>"
#: Fields without which a raw job is not decoded.
RAW_REQUIRED = ("title", "description", "source", "url", "posted_at")
DETAIL_TEXTS = ("requirements", "responsibilities", "benefits", "additional", "work_schedule", "contact_text")
DETAIL_LISTS = ("contact_phone_numbers", "contact_telegram_usernames", "contact_links")
DETAILS = ", ".join([f"{c} STRING" for c in DETAIL_TEXTS] + [f"{c} ARRAY<STRING>" for c in DETAIL_LISTS])
JOBS = f"id STRING, title STRING, company STRING, description STRING, salary STRING, location STRING, source STRING, source_url STRING, posted_at TIMESTAMP, created_at TIMESTAMP, {DETAILS}, telegram_published_at TIMESTAMP, dedup_hash STRING, source_post_hash STRING"
CHANNEL_POSTS = "id STRING, job_id STRING, channel_chat_id STRING, telegram_message_id BIGINT, caption STRING, banner_image_path STRING, published_at TIMESTAMP, created_at TIMESTAMP"
REGISTRATION = "plugin_name STRING, channel STRING, source STRING, enabled BOOLEAN"
OUTCOMES = "source STRING, url STRING, posted_at TIMESTAMP, outcome STRING, reason STRING"
DEAD_LETTERS = "plugin_name STRING, channel STRING, id BIGINT, url STRING, error STRING"
ATTEMPTS = "key STRING, job_id STRING, channel_chat_id STRING, caption STRING, html BOOLEAN, message_id BIGINT, error STRING, at TIMESTAMP"
