"""rankweave: ranked recommendations as Spark DataFrame plans.

Interactions ``(user_id, item_id, value, ts)``, a user table and an item table go in; the top-k items
per user with a per-signal breakdown come out.  Everything is DataFrame to DataFrame and works for a
whole table of users at once.
"""
