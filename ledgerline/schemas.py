"""Schemas of the engine's tables."""

MISSIONS = (
    "id string, title string, giver string, variant string, grade string, contract_template string, contract_definition_id string, status string, "
    "payout long, payout_confidence string, reward long, source string, accepted_at long, completed_at long, notes string, created_seq long, "
    "title_pickup string, title_dropoff string, session string, terminal_source string"
)
LEGS = (
    "mission_id string, objective_id string, kind string, commodity string, scu_total long, scu_delivered long, location string, "
    "pos_x double, pos_y double, pos_z double, completed boolean, manual_override long"
)
EARNINGS = "amount long, ts long, mission_id string, confidence string"
FINES = "amount long, ts long"
EVENTS = (
    "seq long, source string, type string, ts long, mission_id string, objective_id string, kind string, title string, title_pickup string, "
    "title_dropoff string, giver string, contract_template string, contract_definition_id string, position struct<x:double,y:double,z:double>, "
    "commodity string, scu_total long, location string, completion_type string, reason string, amount long, location_id string"
)
