"""salonlake: booking-business analytics as Spark DataFrame jobs.

Tables (users, customers, services, appointments, transactions, inventory,
inventory_changes) are plain DataFrames; every operator is a function
DataFrame(s) -> DataFrame that only builds a logical plan, so Catalyst and
AQE choose the physical strategy at run time.
"""

from salonlake.params import AS_OF, PERIOD, Period

__all__ = ["AS_OF", "PERIOD", "Period"]
