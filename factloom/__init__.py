"""factloom: bitemporal assertion analytics as Spark DataFrame plans."""
