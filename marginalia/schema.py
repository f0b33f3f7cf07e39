"""Tables of the engine, as Spark schemas."""

from __future__ import annotations

SYNC_STATE = "note_path string, page_id string, parent_id string, content_hash string, frontmatter_hash string, local_mtime timestamp, remote_mtime timestamp, last_sync timestamp, sync_direction string, status string"
LINKS = "source_path string, target_name string, target_path string, page_id string, resolved boolean"
PAGE_ALIASES = "note_path string, alias_name string, alias_type string"
SYNC_HISTORY = "seq long, note_path string, action string, ts timestamp, content_hash string, details string"
REMOTE_PAGES = "page_id string, last_edited timestamp, created timestamp, archived boolean, error string"
BLOCKS = "page_key string, block_path array<int>, depth int, type string, attrs map<string,string>, rich_text array<struct<type:string,content:string,link:string,page_id:string,bold:boolean,italic:boolean,strike:boolean,underline:boolean,code:boolean,color:string>>"

#: Fixed values.
CHANGE_TYPES = ("created", "modified", "deleted", "renamed", "conflict")
DIRECTIONS = ("push", "pull", "both")
STATUSES = ("pending", "synced", "conflict")
