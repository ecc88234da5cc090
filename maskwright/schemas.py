"""The tables of a vault and of what crosses, as DDL."""

ATTRIBUTES = (
    "struct<entity_type:string,jurisdiction:string,roles:array<string>,relations:array<struct<type:string,target_name:string,pct:double>>,vessel_type:string,"
    "identifier_of_name:string,identifier_type:string,also_kind:string,fragment:string,shared_by:array<string>,source:string>"
)
TOKENS = f"scope_id string, token string, kind string, real_value string, normalized string, status string, canonical_token string, attributes {ATTRIBUTES}, seq long"
ALIASES = "scope_id string, token string, surface string, normalized string, source string, seq long"
SALTS = "scope_id string, salt binary"
SEED_ENTITIES = (
    "scope_id string, type string, name string, identifier string, identifier_type string, jurisdiction_country string, role string, attributes map<string,string>, "
    "relationships array<struct<type:string,target:string,shareholding_pct:double>>, seq long"
)
SEED_PARTIES = "scope_id string, name string, role string, seq long"
REDACTION = (
    "doc_id long, scope_id string, text string, entity_types array<string>, redacted_count int, mapping map<string,string>, glossary array<string>, "
    "surfaces map<string,array<string>>, canonical map<string,string>, spans array<struct<start:int,end:int,out_start:int,out_end:int,token:string>>"
)
AUDIT = "at timestamp, actor_id string, action string, resource_type string, plane string, sensitivity string, content_hash string, detail struct<target:string,entity_types:array<string>,redacted_count:int>"
ATTRIBUTE_NAMES = ("entity_type", "jurisdiction", "roles", "relations", "vessel_type", "identifier_of_name", "identifier_type", "also_kind", "fragment", "shared_by", "source")
