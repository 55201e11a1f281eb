"""Schemas of the stored files.  Ids are unsigned 64-bit, hence DECIMAL(20,0) at the border."""

VERSION = 1
FLAGS = ["test", "public", "is_async", "generic", "foreign", "uses_unsafe"]
SPAN = "struct<file:string,line_start:bigint,line_end:bigint>"
CHARACTERISTICS = "struct<" + ",".join(f"{f}:boolean" for f in FLAGS) + ">"
SYMBOL = f"struct<id:decimal(20,0),fq_path:string,crate_name:string,span:{SPAN},characteristics:{CHARACTERISTICS}>"
EDGE = "struct<`from`:decimal(20,0),`to`:decimal(20,0),kind:string>"
DYN_CALL = "struct<owner:decimal(20,0),trait_path:string,method:string>"
IMPL_METHOD = "struct<trait_path:string,method:string,fq_path:string,generic:boolean>"
FRAGMENT = f"symbols array<{SYMBOL}>, edges array<{EDGE}>, dyn_calls array<{DYN_CALL}>, impl_methods array<{IMPL_METHOD}>"
INDEX = f"schema_version int, symbols array<{SYMBOL}>, edges array<{EDGE}>"
MANIFEST = "schema_version int, toolchain string, file_hashes map<string,string>, cargo_lock_hash string, indexed_at string"
EDGE_KINDS = ("Static", "Virtual")
