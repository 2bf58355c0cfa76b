"""Schemas of the stored tables, fixed and never inferred."""

BASKETS = "id long, label string, items array<string>"
EVIDENCE = "variant_count long, base_count long, jsd_bits double, null95_bits double, jsd_to_null_ratio double, variant_top array<struct<label:string,share:double,lift:double>>, base_top array<struct<label:string,share:double,lift:double>>"
DECISIONS = "decision_id string, decision string, decided_by string, note string"
VOCABULARY = "id string, name string, category string, parent_id string, train_mention_count long, preserve_evidence struct<layer:string,jsd_bits:double,null95_bits:double,variant_count:long>, aliases array<struct<alias:string,source:string,rule:string,train_frequency:long>>"
STAGED = "id long, label string, item_ids array<string>, unresolved array<string>, raw_count int"
PARAMETERS = "label string, index int, coefficient double"
