"""Schemas of the engine's tables. All are keyed by ``traj_id``; ``ord`` is a contact's place in its file."""

from __future__ import annotations

CONTACTS_RAW = "ord bigint, i int, j int, r6 double, r12 double, r double"
CONTACTS = "ord bigint, i int, j int, r double, cluster int"
POINT = "struct<x:double,y:double,z:double>"
FRAMES = f"traj_id string, frame int, coords map<int,{POINT}>"
COORDS = "traj_id string, frame int, residue int, x double, y double, z double"
RESULTS = "traj_id string, frame int, contacts bigint, q double, contact_list array<struct<i:int,j:int>>, clusters_filling map<int,double>"
FILL = "traj_id string, frame int, cluster int, n bigint, size bigint"
SERIES = "traj_id string, frame int, cluster int, value double"
SUMMARY = "traj_id string, widx bigint, frame int, cluster int, value double"
ORDER = "traj_id string, rank int, cluster int"
