"""postflock: social post analytics as PySpark DataFrame functions."""
