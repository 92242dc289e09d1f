"""The registered queries stated once more as plain SQL, for checking results."""
