"""Project definitions, source assembly and builds."""
